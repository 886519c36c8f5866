"""License scans by diagonal voting.

Words of a text are joined, as rolling k-gram hashes, to the positions of license templates.
Each match votes for a diagonal (place in the text less place in the template). Votes are
counted by diagonal; neighbouring diagonals of one template, which insertions and
deletions part, are merged; a merged span is verified by the share of the template's words that its
matched k-grams cover, all of them for templates of few words, and by k-grams that no other label's templates have: what tells
licenses apart must be there, so that a non-commercial notice is not taken for one that grants more. Templates are whole license
texts, file headers and single notices. Short phrases are templates too: they hold where one diagonal has all their
k-grams. Phrases have k-grams of two words and notices of four; one join by the hash of the first two words serves both, and
matches compare all words of the k-gram, so no label rests on a hash.

The templates are a table of fixed size, which is broadcast; texts are never shuffled.

Defined cases: very long texts are read whole, in time in proportion to their words; a null text is empty; a text without words has no labels, null places and score 0;
rows that repeat get the same result each; a null id is a value like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, with their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Public license notices, with their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

# The Creative Commons licenses' elements, and versions of their names.
ELEMENTS = {"": "", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives", "nc sa": "noncommercial sharealike", "nc nd": "noncommercial noderivatives"}
VERSIONS = ["4 0 international", "3 0 unported"]


def commons() -> list[tuple[str, str]]:
    """Notices of the Creative Commons licenses: short, by name, and as a sentence."""
    out = []
    for short, name in ELEMENTS.items():
        label = "-".join(["cc", "by", *short.split()])
        for version in VERSIONS:
            out.append((" ".join(["licensed under cc by", *short.split(), *version.split()[:2]]), label))
            full = " ".join(["creative commons attribution", *name.split(), version])
            out += [(full, label), (f"this work is licensed under a {full} license", label)]
    return out


# Whole license texts and file headers, by their words, with their labels.
TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", "zlib"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors", "unlicense"),
]

#: Words of a k-gram for phrases and for notices; diagonals so near are merged; share of a notice's words that must be found; notices of fewer words than this must be found whole.
PHRASE_K, NOTICE_K, NEAR, COVERED, FEW = 2, 4, 3, 0.6, 10
#: Of the k-grams that only a label's templates have, the share (one in so many) that must be found.
OWN = 3
LONG = NOTICES + commons() + TEXTS


def templates(spark: SparkSession) -> DataFrame:
    """One row per k-gram of a template: its first two words' hash, its words, its place, whether no other label has it, and how many such the template has."""
    grams = [(n, label, k, text.split(), i) for n, (text, label, k) in enumerate([(*p, PHRASE_K) for p in PHRASES] + [(*p, NOTICE_K) for p in LONG]) for i in range(len(text.split()) - k + 1)]
    labels, owns = {}, {}
    for _, label, k, w, i in grams:
        labels.setdefault(tuple(w[i : i + k]), set()).add(label)
    own = [len(labels[tuple(w[i : i + k])]) == 1 for _, _, k, w, i in grams]
    for (n, *_), o in zip(grams, own, strict=True):
        owns[n] = owns.get(n, 0) + o
    rows = [(n, label, k == PHRASE_K, len(w), i, o, owns[n], *w[i : i + k], *[None] * (NOTICE_K - k)) for (n, label, k, w, i), o in zip(grams, own, strict=True)]
    t = spark.createDataFrame(rows, "template int, label string, phrase boolean, t_words int, t_at int, own boolean, t_owns int, t0 string, t1 string, t2 string, t3 string")
    return F.broadcast(t.withColumn("gram", F.xxhash64("t0", "t1")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def votes(rows: DataFrame) -> DataFrame:
    """(doc_id, _th, template, ..., diagonal, t_ats, owns, at, end) over rows of doc_id, _th, words."""
    w = F.col("words")
    grams = rows.select("doc_id", "_th", F.posexplode(F.arrays_zip(w.alias("w0"), F.slice(w, 2, F.lit(1 << 30)).alias("w1"), F.slice(w, 3, F.lit(1 << 30)).alias("w2"), F.slice(w, 4, F.lit(1 << 30)).alias("w3"))).alias("at", "g"))
    grams = grams.select("doc_id", "_th", "at", F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3")).withColumn("gram", F.xxhash64("w0", "w1"))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("phrase") | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))))
    hits = grams.join(templates(rows.sparkSession), "gram").filter(same)
    # Sets and extremes, so that a row that occurs twice votes once.
    return hits.groupBy("doc_id", "_th", "template", "label", "phrase", "t_words", "t_owns", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("t_at").alias("t_ats"), F.collect_set(F.when(F.col("own"), F.col("t_at"))).alias("owns"), F.min("at").alias("at"), F.max("at").alias("end"))


def merged(found: DataFrame) -> DataFrame:
    """Notices' spans: neighbouring diagonals as one, with the share of the template that they cover, and whether they hold."""
    w = Window.partitionBy("doc_id", "_th", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True)).cast("int")
    spans = found.withColumn("apart", apart).withColumn("span", F.sum("apart").over(w))
    spans = spans.groupBy("doc_id", "_th", "template", "label", "t_words", "t_owns", "span").agg(F.flatten(F.collect_list("t_ats")).alias("t_ats"), F.size(F.array_distinct(F.flatten(F.collect_list("owns")))).alias("owns"), F.min("at").alias("at"), (F.max("end") + NOTICE_K).alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_ats", lambda p: F.sequence(p, p + NOTICE_K - 1)))))
    spans = spans.withColumn("share", covered.cast("double") / F.col("t_words")).drop("t_ats")
    return spans.withColumn("holds", (F.col("share") >= F.when(F.col("t_words") < FEW, 1.0).otherwise(COVERED)) & (OWN * F.col("owns") >= F.col("t_owns")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_th"), words_of(F.col(text_col)).alias("words"))
    found = votes(rows)
    phrases = found.filter(F.col("phrase") & (F.size("t_ats") == F.col("t_words") - PHRASE_K + 1)).select("doc_id", "_th", "label", F.lit(True).alias("base"), F.col("diagonal").alias("at"), F.lit(1.0).alias("share"), F.lit(True).alias("holds"))
    notices = merged(found.filter(~F.col("phrase"))).select("doc_id", "_th", "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("at"), "share", "holds")
    ok = F.when(F.col("holds"), F.col("label"))
    result = phrases.unionByName(notices).groupBy("doc_id", "_th").agg(
        F.count("at").alias("n_base"),
        F.min("at").cast("long").alias("first_word"),
        F.max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(ok)), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    light = rows.select("doc_id", "_th", F.size("words").cast("long").alias("n_words")).alias("r")
    joined = light.join(result.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r._th") == F.col("m._th")), "left")
    return joined.select("r.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _values(rows, k: int) -> str:
    return ", ".join(f"({n}, '{text}', '{label}', {k})" for n, (text, label) in enumerate(rows))


SQL = {
    "op1_licenses": rf"""
WITH t AS (SELECT n + 1000 * (4 - k) AS n, string_split(x, ' ') AS x, label, k FROM (VALUES {_values(PHRASES, 2)}, {_values(LONG, 4)}) v(n, x, label, k)),
tg AS (SELECT n, label, k, len(x) AS l, unnest(range(0, len(x) - k + 1)) AS p, x FROM t),
tm AS (SELECT n, label, k, l, p, array_to_string(x[p + 1:p + k], ' ') AS g FROM tg),
tl AS (SELECT g, k, count(DISTINCT label) = 1 AS own FROM tm GROUP BY g, k),
tk AS (SELECT n, label, k, l, p, g, own, count(*) FILTER (own) OVER (PARTITION BY n) AS o FROM tm JOIN tl USING (g, k)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
d2 AS (SELECT doc_id, unnest(list_transform(range(1, len(a)), lambda i: {{'i': i - 1, 'g': array_to_string(a[i:i + 1], ' ')}})) AS u, 2 AS k FROM w),
d4 AS (SELECT doc_id, unnest(list_transform(range(1, len(a) - 2), lambda i: {{'i': i - 1, 'g': array_to_string(a[i:i + 3], ' ')}})) AS u, 4 AS k FROM w),
v AS (SELECT d.doc_id, tk.n, tk.label, tk.k, tk.l, d.u.i - tk.p AS g, tk.p, tk.own, tk.o FROM (SELECT * FROM d2 UNION ALL SELECT * FROM d4) d JOIN tk ON tk.k = d.k AND tk.g = d.u.g),
b AS (SELECT doc_id, label, g AS pos, 1.0::DOUBLE AS share FROM v WHERE k = 2 GROUP BY doc_id, n, label, l, g HAVING count(DISTINCT p) = l - 1),
c AS (SELECT *, CASE WHEN g - lag(g) OVER q > {NEAR} OR lag(g) OVER q IS NULL THEN 1 ELSE 0 END AS s FROM v WHERE k = 4 WINDOW q AS (PARTITION BY doc_id, n ORDER BY g)),
e AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, n ORDER BY g RANGE UNBOUNDED PRECEDING) AS z FROM c),
f AS (SELECT doc_id, label, n, l, o, z, p AS first, own, unnest([p, p + 1, p + 2, p + 3]) AS p FROM e),
h AS (SELECT doc_id, label, NULL::BIGINT AS pos, count(DISTINCT p)::DOUBLE / l AS share,
             count(DISTINCT p)::DOUBLE / l >= CASE WHEN l < {FEW} THEN 1 ELSE {COVERED} END AND {OWN} * count(DISTINCT first) FILTER (own) >= o AS holds FROM f GROUP BY doc_id, label, n, l, o, z),
m AS (SELECT *, true AS holds, true AS base FROM b UNION ALL SELECT *, false FROM h),
r AS (SELECT doc_id, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label) FILTER (holds)), ',') AS labels, max(share) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN r USING (doc_id)"""
}
