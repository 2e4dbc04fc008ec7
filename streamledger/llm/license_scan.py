"""License scans with ordered signature rules, with DataFrame operations only.

A text becomes its words in lower case, one blank between them, and rules are regular
expressions over that line. A rule is tried only where its keyword stands in the
text. What the rules find are word intervals; an interval inside another of the same
or a higher priority is suppressed, as are equal intervals of a lower priority or a
later rule. Everything happens within the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamledger.llm.common import text_or_empty

#: Phrases that are counted everywhere, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Fixed rules: label, priority (3 names a license and its terms, 2 a license, 1 a hint), keyword, pattern over words.
_FIXED = r"""
apache-2.0 | 3 | apache | licensed under the apache license version 2( 0)?
apache-2.0 | 3 | apache | apache license version 2 0( january 2004)?
apache-2.0 | 2 | apache | apache( software)? licen[sc]e v?2( 0)?
apache-2.0 | 2 | apache | apache 2( 0)? licen[sc]ed?
apache-1.1 | 3 | apache | apache( software)? license version 1 1
apache-1.0 | 3 | apache | apache( software)? license version 1 0
apache | 1 | apache | apache( software)? licen[sc]e
mit | 3 | mit | (released|licensed|distributed|available) under (the )?(terms of the )?mit licen[sc]e
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 2 | mit | the mit license( mit)?
mit | 1 | mit | mit licen[sc]ed?
mit-0 | 3 | mit | mit no attribution( license)?
x11 | 2 | x11 | x11 license
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | (the )?isc licen[sc]e
0bsd | 3 | bsd | (bsd zero clause|zero clause bsd) license
bsd-2-clause | 3 | bsd | (simplified|freebsd|2 clause) bsd( 2 clause)? licen[sc]e
bsd-2-clause | 3 | bsd | bsd 2 clause( simplified)?( licen[sc]e)?
bsd-3-clause | 3 | bsd | (new|modified|revised|3 clause) bsd licen[sc]e
bsd-3-clause | 3 | bsd | bsd 3 clause( new or revised)?( licen[sc]e)?
bsd-4-clause | 3 | bsd | (original|old|4 clause) bsd licen[sc]e
bsd-4-clause | 3 | bsd | bsd 4 clause( licen[sc]e)?
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | bsd | bsd( style)? licen[sc]ed?
mpl-2.0 | 3 | mozilla | mozilla public licen[sc]e v(ersion)? ?2 0
mpl-1.1 | 3 | mozilla | mozilla public licen[sc]e v(ersion)? ?1 1
mpl-1.0 | 3 | mozilla | mozilla public licen[sc]e v(ersion)? ?1 0
mpl | 2 | mozilla | mozilla public licen[sc]e
mpl-2.0 | 2 | mpl | mpl 2 0
epl-2.0 | 3 | eclipse | eclipse public licen[sc]e v(ersion)? ?2 0
epl-1.0 | 3 | eclipse | eclipse public licen[sc]e v(ersion)? ?1 0
epl | 2 | eclipse | eclipse public licen[sc]e
edl-1.0 | 2 | eclipse | eclipse distribution licen[sc]e
cddl-1.1 | 3 | cddl | cddl( version)? 1 1
cddl-1.0 | 3 | cddl | cddl( version)? 1 0
cddl | 2 | common | common development and distribution licen[sc]e
cpl-1.0 | 2 | common | common public licen[sc]e( version 1 0)?
cpal-1.0 | 2 | common | common public attribution licen[sc]e
ipl-1.0 | 2 | ibm | ibm public licen[sc]e
eupl-1.2 | 3 | european | european union public licen[sc]e v(ersion)? ?1 2
eupl-1.1 | 3 | european | european union public licen[sc]e v(ersion)? ?1 1
eupl | 2 | european | european union public licen[sc]e
cecill | 2 | cecill | cecill( free software)? licen[sc]e
artistic-2.0 | 3 | artistic | artistic licen[sc]e( version)? 2 0
artistic-1.0 | 3 | artistic | artistic licen[sc]e( version)? 1 0
artistic | 2 | artistic | (perl )?artistic licen[sc]e
zlib | 3 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 2 | zlib | zlib( libpng)? licen[sc]e
libpng | 2 | libpng | libpng licen[sc]e
bsl-1.0 | 3 | boost | boost software licen[sc]e( version)? 1 0
bsl-1.0 | 2 | boost | boost (software )?licen[sc]e
busl-1.1 | 3 | business | business source licen[sc]e( version)?( 1 1)?
sspl-1.0 | 3 | server | server side public licen[sc]e
elastic-2.0 | 3 | elastic | elastic licen[sc]e( version)? 2( 0)?
elastic | 2 | elastic | elastic licen[sc]e
commons-clause | 3 | commons | commons clause (license )?condition
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | the unlicense
wtfpl | 3 | wtfpl | wtfpl( version)?( 2)?
wtfpl | 3 | want | do what the fuck you want to public licen[sc]e
public-domain | 2 | domain | (released|placed|dedicated) (in|into|to) the public domain
public-domain | 1 | domain | public domain
cc0-1.0 | 3 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | 3 | dedication | public domain dedication
pddl-1.0 | 3 | pddl | pddl( 1 0)?
odbl-1.0 | 3 | database | open database licen[sc]e
odc-by-1.0 | 3 | commons | open data commons attribution licen[sc]e
ofl-1.1 | 3 | sil | sil open font licen[sc]e( version)?( 1 1)?
ofl | 2 | font | open font licen[sc]e
gfdl-1.3 | 3 | documentation | (gnu )?free documentation licen[sc]e version 1 3
gfdl-1.2 | 3 | documentation | (gnu )?free documentation licen[sc]e version 1 2
gfdl-1.1 | 3 | documentation | (gnu )?free documentation licen[sc]e version 1 1
gfdl | 2 | documentation | (gnu )?free documentation licen[sc]e
python-2.0 | 2 | python | python( software foundation)? licen[sc]e
php-3.01 | 3 | php | php licen[sc]e( version)? 3 01
php | 2 | php | (the )?php licen[sc]e
ruby | 2 | ruby | ruby licen[sc]e
openssl | 2 | openssl | openssl( toolkit)? licen[sc]e
postgresql | 2 | postgresql | postgresql licen[sc]e
ncsa | 2 | ncsa | (university of illinois )?ncsa open source licen[sc]e
w3c | 2 | w3c | w3c software( notice and)? licen[sc]e
unicode | 2 | unicode | unicode( data files and software)? licen[sc]e
ms-pl | 2 | microsoft | microsoft public licen[sc]e
ms-rl | 2 | microsoft | microsoft reciprocal licen[sc]e
apsl-2.0 | 2 | apple | apple public source licen[sc]e
osl-3.0 | 2 | osl | osl 3 0
osl-3.0 | 3 | open | open software licen[sc]e( v(ersion)?)? ?3 0
afl-3.0 | 2 | academic | academic free licen[sc]e
ecl-2.0 | 2 | educational | educational community licen[sc]e
qpl-1.0 | 2 | public | q public licen[sc]e
sleepycat | 2 | sleepycat | sleepycat licen[sc]e
beerware | 2 | beer | the beer ?ware licen[sc]e
json | 3 | evil | the software shall be used for good not evil
vim | 2 | vim | vim licen[sc]e
curl | 2 | curl | curl licen[sc]e
ftl | 2 | freetype | freetype( project)? licen[sc]e
ijg | 2 | jpeg | independent jpeg group( s)? (licen[sc]e|software)
naist | 2 | naist | naist licen[sc]e
nasa-1.3 | 2 | nasa | nasa open source agreement
lppl-1.3c | 2 | latex | latex project public licen[sc]e
ogl-uk-3.0 | 3 | government | open government licen[sc]e v(ersion)? ?3( 0)?
ogl-uk | 2 | government | open government licen[sc]e
etalab-2.0 | 2 | etalab | etalab (2 0|open licen[sc]e)
openrail | 3 | rail | (creativeml )?open ?rail( m| plus plus m)?( licen[sc]e)?
llama-community | 2 | llama | llama( [0-9]+)* community licen[sc]e
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 2 | unauthorized | unauthorized copying (of this file|via any medium)
non-commercial | 1 | commercial | non ?commercial( use)?( only)?
no-derivatives | 1 | derivatives | no ?derivatives
share-alike | 1 | alike | share alike
copyright-notice | 1 | copyright | copyright( c)? (19|20)[0-9][0-9]
copyright-notice | 1 | copyright | copyright( c)?( [^ ]+){1,4} all rights reserved
reserved | 1 | reserved | (all|some|no) rights reserved
license-file | 1 | license | see (the )?(accompanying )?license( file| txt| md)?
license-file | 1 | license | license that can be found in the license file
spdx | 2 | spdx | spdx license identifier [^ ]+
"""

_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(ative)?s", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(ative)?s"}
_GNU = {"gpl": "(gnu )?general public licen[sc]e", "lgpl": "(gnu )?(lesser|library) general public licen[sc]e", "agpl": "(gnu )?affero general public licen[sc]e"}
_GNU_VERSIONS = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3")}


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: the fixed ones, then the families of Creative Commons and GNU licenses by variant and version."""
    out = []
    for line in _FIXED.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), keyword, pattern))
    for variant, name in _CC.items():
        code = variant.replace("-", " ")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            out.append((f"cc-{variant}-{version}", 3, "cc", f"cc {code} {number}"))
            out.append((f"cc-{variant}-{version}", 3, "creative", f"creative commons {name} {number}( international| unported| generic)?( licen[sc]e)?"))
        out.append((f"cc-{variant}", 2, "cc", f"cc {code}"))
        out.append((f"cc-{variant}", 2, "creative", f"creative commons {name}( licen[sc]e)?"))
    out.append(("cc", 1, "creative", "creative commons"))
    for name, words in _GNU.items():
        for version in _GNU_VERSIONS[name]:
            number = version.replace(".", " ")
            given = rf"v(ersion)? ?{number}( 0)?"
            out.append((f"{name}-{version}-or-later", 3, "public", rf"{words} {given} or( at your option)?( \(at your option\))? (any )?later( version)?"))
            out.append((f"{name}-{version}", 3, "public", f"{words} {given}"))
            out.append((f"{name}-{version}", 2, name, rf"{name} ?v?{number}( 0)?"))
        out.append((name, 2, "public", words))
    out.append(("gpl", 1, "gpl", "gpl"))
    out.append(("lgpl", 1, "lgpl", "lgpl"))
    out.append(("agpl", 1, "agpl", "agpl"))
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_line(text: Column) -> Column:
    """The words in lower case (A-Z only) with one blank before, between and after; one blank if there are none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    line = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return line


def _places(line: str, pattern: str) -> str:
    """SQL for an array of (start, stop) in words of a pattern's places; the pattern is made of whole words."""
    own = f"concat('(?<= )(?:', {pattern}, ')(?= )')"
    blanks = "length({0}) - length(replace({0}, ' ', ''))"
    gap, hit = blanks.format("element_at(a.gaps, i)"), blanks.format("element_at(a.hits, i)")
    return f"""
      aggregate(
        sequence(1, greatest(1, regexp_count({line}, {own}))),
        named_struct('gaps', split({line}, {own}, -1), 'hits', regexp_extract_all({line}, {own}, 0), 'at', -1,
                     'out', cast(array() as array<struct<start:int,stop:int>>)),
        (a, i) -> if(i > size(a.hits), a, named_struct(
          'gaps', a.gaps, 'hits', a.hits, 'at', cast(a.at + {gap} + {hit} as int),
          'out', array_append(a.out, named_struct('start', cast(a.at + {gap} as int), 'stop', cast(a.at + {gap} + {hit} + 1 as int))))),
        a -> a.out)"""


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, places, detections, base_labels, labels, score`` for each row of ``docs(doc_id, text)``.

    ``places`` are all places of the base phrases (label, start, stop in words), counted even
    where they lie inside a longer find; ``detections`` are the rules' finds that were not
    suppressed. Labels are sorted and distinct. ``score`` is 1.0, 0.8 or 0.5 by the highest
    priority found, at least 0.6 with a base phrase, else 0. Null texts are empty: no words,
    no labels. Rows that repeat are scanned one by one; other columns are ignored.
    """
    table = rules()
    line = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_line(text_or_empty("text")).alias("line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) - 1
    base = ", ".join(
        f"if(contains(line, ' {phrase} '), transform({_places('line', _quoted(phrase))}, p -> named_struct('label', '{label}', 'start', p.start, 'stop', p.stop)), "
        "cast(array() as array<struct<label:string,start:int,stop:int>>))"
        for phrase, label in BASE
    )
    keywords = sorted({r[2] for r in table})
    gate = f"filter(array({', '.join(map(_quoted, keywords))}), k -> contains(line, k))"
    signatures = ", ".join(
        f"named_struct('label', {_quoted(label)}, 'priority', {priority}, 'rule', {number}, 'keyword', {_quoted(keyword)}, 'pattern', {_quoted(pattern)})"
        for number, (label, priority, keyword, pattern) in enumerate(table)
    )
    # sorted so that whatever can contain an interval comes before it
    finds = f"""
      array_sort(flatten(transform(
        filter(array({signatures}), s -> array_contains(keywords, s.keyword)),
        s -> transform({_places('line', 's.pattern')},
               p -> named_struct('start', p.start, 'back', -p.stop, 'low', -s.priority, 'rule', s.rule, 'label', s.label)))))"""
    kept = """
      aggregate(finds, named_struct('s1', -1, 's2', -1, 's3', -1, 'out', cast(array() as array<struct<start:int,stop:int,priority:int,label:string>>)),
        (a, d) -> named_struct(
          's1', greatest(a.s1, -d.back), 's2', if(d.low <= -2, greatest(a.s2, -d.back), a.s2), 's3', if(d.low <= -3, greatest(a.s3, -d.back), a.s3),
          'out', if(element_at(array(a.s1, a.s2, a.s3), -d.low) >= -d.back, a.out,
                    array_append(a.out, named_struct('start', d.start, 'stop', -d.back, 'priority', -d.low, 'label', d.label)))),
        a -> a.out)"""
    none = "cast(array() as array<struct<start:int,back:int,low:int,rule:int,label:string>>)"
    out = line.withColumns({"n_words": F.greatest(words, F.lit(0)).cast("long"), "places": F.expr(f"flatten(array({base}))"), "keywords": F.expr(gate)})
    out = out.withColumn("finds", F.expr(f"if(size(keywords) = 0, {none}, {finds})")).withColumn("detections", F.expr(kept))
    base_labels = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("detections.label"))))
    top = F.array_max(F.col("detections.priority"))
    score = F.greatest(
        F.when(top == 3, 1.0).when(top == 2, 0.8).when(top == 1, 0.5).otherwise(0.0), F.when(F.size("places") > 0, 0.6).otherwise(0.0)
    )
    return out.select(
        "doc_id", "n_words", "places", "detections", F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score")
    )
