"""Near-duplicates, line dedup and decontamination against brute force, on odd tables."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from streamledger.llm.common import connected_components
from streamledger.llm.decontaminate import overlaps, without_leaks
from streamledger.llm.line_dedup import counted, without_repeated_lines
from streamledger.llm.near_dedup import near_duplicates, one_of_each

DOCS = "doc_id long, text string, lang string, row long, node string, own_row int, kept_row int, gone_row int, leak_id int, n_chars long"
EXTRA = (None, 7, "n", 1, 2, 3, 4, 5)
SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = re.findall(SPACE, lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def texts():
    """Random texts, copies and near copies of them, and odd ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 30, 80, 200]))]
        for k in range(rng.choice([1, 1, 3, 6])):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(w + ("\n" if rng.random() < 0.1 else "") for w in own))
    out += [None, "", "   ", "\n\n", "A b C", "a  B\tc", "é ü x ß", "one", "😀 " * 50, " ".join(vocabulary * 40), " ".join(vocabulary * 40) + " end"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    found = texts()
    rows = [(i, t) for i, t in enumerate(found)] + [(3, found[3]), (3, found[3]), (4, "another text with one id more than once"), (None, found[0]), (None, "alone without an id here")]
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS).repartition(3).cache()


def components(rows, linked):
    """Union-find over rows; the smallest id, null last, names a component."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a], rows[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(find(k), []).append(r["doc_id"])
    return [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))]


def test_near_duplicates_equal_all_pairs(docs):
    rows = docs.collect()
    sets = {r["text"]: shingles(r["text"]) for r in rows}

    def linked(x, y):
        a, b = sets[x["text"]], sets[y["text"]]
        return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)

    own = components(rows, linked)
    expected = sorted(((r["doc_id"], len(sets[r["text"]]), c, r["doc_id"] == c) for r, c in zip(rows, own)), key=str)
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {(c, r["text"] if not sets[r["text"]] or c is None else "") if c is None or not sets[r["text"]] else c for r, c in zip(rows, own)}
    assert kept.count() >= len(groups) - 1


def test_near_duplicates_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_a_large_group_is_dealt_in_blocks(spark, monkeypatch):
    from streamledger.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", 100)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    own = components([{"doc_id": i, "k": i} for i, _ in rows], lambda a, b: 100 * len(sets[a["k"]] & sets[b["k"]]) >= 75 * len(sets[a["k"]] | sets[b["k"]]))
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(own))


def test_components_of_chains_and_circles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (42, 40), (50, 50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 42: 40}


def later_lines(rows, threshold=0.9, least=1):
    seen, gone = [], set()
    for k, r in sorted(enumerate(rows), key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0])):
        for n, line in enumerate((r["text"] or "").split("\n")):
            words = frozenset(re.findall(SPACE, line.lower()))
            if len(words) >= least:
                if any(len(words & s) >= threshold * len(words | s) - 1e-9 for s in seen):
                    gone.add((k, n))
                seen.append(words)
    return gone


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(80)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 20, 40]))] for _ in range(60)]
    out = []
    for _ in range(50):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(lines))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            own.append(rng.choice([" ", "  ", "\t"]).join(line))
        out.append("\n".join(own))
    rows = [(i, t, *EXTRA) for i, t in enumerate(out)] + [(None, out[0], *EXTRA), (7, out[7], *EXTRA), (90, None, *EXTRA), (91, "", *EXTRA), (92, "\n \n", *EXTRA)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1).cache()
    given = docs.collect()
    gone = later_lines(given)
    expected = sorted(((r["doc_id"], len((r["text"] or "").split("\n")), ",".join(str(n) for k2, n in sorted(gone) if k2 == k)) for k, r in enumerate(given)), key=str)
    got = counted(docs).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["removed"]) for r in got), key=str) == expected
    assert all(r["n_removed"] == len([x for x in r["removed"].split(",") if x]) for r in got)
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns
    left = []
    for k, r in enumerate(given):
        own = [n for k2, n in gone if k2 == k]
        text = "\n".join(x for n, x in enumerate((r["text"] or "").split("\n")) if n not in own) if own else r["text"]
        if not own or text.strip(" \t\n\r\x0b\x0c"):
            left.append((r["doc_id"], text))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(left, key=str)


def test_line_dedup_splits_long_lists_and_tries_all_fits(spark, monkeypatch):
    from streamledger.llm import line_dedup

    monkeypatch.setattr(line_dedup, "LIST", 2)
    base = [f"a{i}" for i in range(30)]
    rows = [(i, " ".join([*base[:i], f"z{i}", *base[i + 1 :]])) for i in range(30)]
    rows += [(100 + i, " ".join([*base, *(f"q{i}{k}" for k in range(4))])) for i in range(3)] + [(200, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    given = docs.collect()
    assert {r["doc_id"] for r in counted(docs).collect() if r["n_removed"]} == {given[k]["doc_id"] for k, _ in later_lines(given)}


def test_line_dedup_tries_no_lines_that_share_rare_words_only(spark, monkeypatch):
    from streamledger.llm import line_dedup

    rng, tried, verified = random.Random(5), [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    # two lines each share three rare words, and no common one but by chance
    rows = [(i, " ".join([*(f"{c}{i // 2}" for c in "abc"), *rng.sample([f"common{k}" for k in range(60)], 8)])) for i in range(80)] + [(90, "one twin"), (91, "twin one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in counted(docs).collect() if r["n_removed"]] == [91]
    assert sum(tried) < 5


def test_one_of_each_joins_the_rows_that_go(spark, monkeypatch):
    from streamledger.llm import near_dedup

    staged, stage = {}, near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, **how: staged.setdefault(name, stage(df, name, **how)))
    texts = [" ".join(f"w{k}x{i}" for i in range(8)) for k in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (50, texts[0]), (60, texts[1]), (70, None), (71, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == [*range(12), 70, 71]
    assert staged["firsts"].count() == 2


def test_line_dedup_looks_up_no_words_of_copies(spark, monkeypatch):
    from streamledger.llm import line_dedup

    looked, later = [], line_dedup._later
    monkeypatch.setattr(line_dedup, "_later", lambda lines, *rest: looked.append(lines.count()) or later(lines, *rest))
    # every word stands in one text only, which stands in ten lines
    docs = spark.createDataFrame([(k, f"alpha{k % 20} beta{k % 20}") for k in range(200)] + [(None, "alpha3 beta3")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in counted(docs).collect() if r["n_removed"]} == {3, *range(20, 200)}
    assert looked[0] < 20
    # full bitmaps tell no copy, and lose none
    monkeypatch.setattr(line_dedup, "COPIES", 64)
    monkeypatch.setattr(line_dedup, "_bitmap", lambda rows, of, most, make=line_dedup._bitmap: make(rows, of, min(most, 64)))
    assert {r["doc_id"] for r in counted(docs).collect() if r["n_removed"]} == {3, *range(20, 200)}
    assert looked[1] > 20


def test_only_what_results_read_stays_staged(spark):
    from streamledger.llm.common import shared_dir
    from streamledger.llm.mixing import mixed
    from streamledger.llm.near_dedup import one_of_each

    folder = Path(shared_dir(spark).removeprefix("file://")) / "staged"
    docs = spark.createDataFrame([(i, "s", f"line {i // 2} of a text\nand one of its own {i}") for i in range(20)], "doc_id long, source string, text string")
    for operator, stays in ((without_repeated_lines, {"numbered", "gone"}), (one_of_each, {"numbered", "firsts"}), (mixed, {"numbered", "shares"}), (counted, {"rows", "gone"})):
        before = {p.name for p in folder.glob("*")}
        found = operator(docs)
        assert found.count() == found.count() > 0
        assert {n.split("-")[0] for n in {p.name for p in folder.glob("*")} - before} == stays


def test_line_dedup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert counted(empty).count() == 0 and without_repeated_lines(empty).count() == 0


BENCH = "item_id long, text string, doc_id int, hash string"


def test_decontamination_finds_passages_with_substitutions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (14, 25, 60, 200)]
    filler = lambda n: [word() for _ in range(n)]
    bench = [(i, " ".join(x), 1, "h") for i, x in enumerate(items)] + [(8, None, 1, "h"), (9, "too short to tell", 1, "h"), (None, " ".join(filler(20)), 1, "h")]
    changed = list(items[2])
    for k in (5, 17, 30, 44):
        changed[k] = word()
    leaks = {
        0: " ".join(filler(30) + items[0] + filler(30)),
        1: ", ".join(filler(500) + [w.upper() for w in items[1]]),
        2: "\n".join(changed),
        3: " ".join(filler(5) + items[3][60:100] + filler(5)),
    }
    clean = {10: " ".join(filler(300)), 11: " ".join(filler(20) + items[3][:6] + filler(20)), 12: None, 13: "", 14: " ".join(rng.sample(items[2], 60))}
    rows = [(k, v, *EXTRA) for k, v in {**leaks, **clean}.items()] + [(0, leaks[0], *EXTRA), (None, leaks[1], *EXTRA), (None, "clean text", *EXTRA)]
    docs, benchmark = spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame(bench, BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in overlaps(docs, benchmark).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (None, 1)}
    first = {r["doc_id"]: (r["first_word"], r["matched"]) for r in overlaps(docs, benchmark).collect()}
    assert first[0] == (30, 14) and first[1] == (500, 25) and first[2] == (0, 56) and first[3] == (5, 40)
    left = without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([*clean, None], key=str)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", *EXTRA)], DOCS)
    none = spark.createDataFrame([], BENCH)
    assert without_leaks(docs, none).count() == 1
    assert without_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g h i j k l m n", 1, "h")], BENCH)).count() == 0


def test_short_benchmark_items_match_whole(spark):
    items = spark.createDataFrame([(1, "Alpha, beta gamma!"), (2, "one two three four five six seven eight nine"), (3, ""), (4, None), (None, "solo words")], "item_id long, text string")
    rows = [(1, "x alpha BETA gamma y"), (2, "alpha beta x gamma"), (3, "alpha beta"), (4, "0 one two three four five six seven eight nine"), (5, "one two three four five six seven eight ten"), (6, "solo words"), (7, "gamma"), (8, None)]
    got = overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["matched"], r["first_word"]) for r in got), key=str) == sorted([(1, 1, 3, 1), (4, 2, 9, 1), (6, None, 2, 0)], key=str)


def test_pipeline_steps_write_no_copy_of_what_they_read(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from streamledger.llm import common

    texts = [f"own words of number {i} " + " ".join(f"w{i}x{k}" for k in range(20)) + ("\nthe line that some of them share" if i % 3 else "") for i in range(24)]
    rows = [*((i, t, "web") for i, t in enumerate(texts)), (None, None, "web"), (3, texts[3], None), (50, texts[0], "web"), (7, "", "a")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given.repartition(5).write.parquet(str(tmp_path / "docs"))
    docs, folder = spark.read.parquet(str(tmp_path / "docs")), Path(common.shared_dir(spark).removeprefix("file://")) / "staged"
    numbers = [r["n"] for r in common.located(docs, "n").collect()]
    assert len(set(numbers)) == len(rows)
    # rows that come twice or were left out are numbered in a copy
    twice = common.located(docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")), "n")
    assert len({r["n"] for r in twice.collect()}) == 2 * len(rows)
    assert len({r["n"] for r in common.located(given, "n").collect()}) == len(rows)
    for step, operator in ((corpus_pipeline.line_dedup, without_repeated_lines), (corpus_pipeline.near_dedup, one_of_each)):
        before = {p.name for p in folder.glob("*")}
        found = step(spark, docs, "")
        assert found.schema.names == docs.columns
        assert "numbered" not in {n.split("-")[0] for n in {p.name for p in folder.glob("*")} - before}
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, operator(given.orderBy("doc_id")).collect()))
    before = {p.name for p in folder.glob("*")}
    assert corpus_pipeline.mixing(spark, docs, "").count() > 0
    assert "numbered" not in {n.split("-")[0] for n in {p.name for p in folder.glob("*")} - before}


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    from streamledger.llm import common

    rows, few = spark.range(500), spark.range(0, 500, 50)
    for most in (common.BITMAP, 64):
        monkeypatch.setattr(common, "BITMAP", most)
        alone, likely = common.sieved(rows, F.xxhash64("id"), few, F.xxhash64("id"))
        assert alone.count() + likely.count() == 500 and likely.join(few, "id").count() == 10
        assert alone.count() > (400 if most > 64 else -1)
