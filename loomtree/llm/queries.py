"""Queries of the text problems (3, 5, 6, 7, 8) and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.llm import canonical, leaks, packing, scans, split
from loomtree.session import table

#: Below the token capacity, so that it binds: three quarters of it.
LOSS_LIMIT = 1_536
#: Limits that all bind: the loss of the mean container, and few slots.
ALL_LIMITS = {"segments": 4, "loss_capacity": 2_000}


def _docs(spark, d):
    return table(spark, d, "documents", spread=True)


def _plans(spark, d):
    return table(spark, d, "batch_plans", spread=True)


def _rejoined(pieces: DataFrame) -> DataFrame:
    """What must hold of every plan's pieces: joined without their overlaps they are the text, none exceeds its limit, and
    each but the first begins with the last tokens of the one before."""
    order = W.partitionBy("plan_id").orderBy("piece_no")
    before = F.lag("end_char").over(order)
    lap = F.coalesce(F.lag("end_token").over(order) - F.col("start_token"), F.lit(0))
    new = F.expr("substring(text, coalesce(before, start_char) - start_char + 1)")
    each = pieces.withColumn("before", before).withColumn("lap", lap).withColumn("new", new)
    kept = (F.col("n_pieces") == 1) | (F.col("n_tokens") <= F.col("token_limit"))
    return each.groupBy("plan_id").agg(
        F.max("total_tokens").alias("n_tokens"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "")).alias("text_hash"),
        F.bool_and(kept).alias("within"), F.bool_and(F.col("lap") == F.col("overlap")).alias("overlapped"),
    )


def _coverage(placed: DataFrame) -> DataFrame:
    """(doc_id, whole, placed): whether a document's pieces follow each other from its first token on, and have a place."""
    order = W.partitionBy("doc_id").orderBy("piece_no")
    follows = F.col("start_token") == F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(order), F.lit(0))
    each = placed.withColumn("follows", follows & (F.col("piece_no") == F.row_number().over(order) - 1))
    return each.groupBy("doc_id").agg(F.bool_and("follows").alias("whole"), F.bool_and(F.col("container_id").isNotNull()).alias("placed"))


def _kept(placed: DataFrame, segments: int = packing.SEGMENTS, loss_capacity: int = packing.CAPACITY) -> DataFrame:
    """Containers that breach a limit, have a gap in their positions, or are split needlessly: none may."""
    each = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(
        F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss_tokens").alias("q"), F.countDistinct("position").alias("p"), F.max("position").alias("m")
    )
    bad = (F.col("t") > packing.CAPACITY) | (F.col("s") > segments) | (F.col("q") > loss_capacity) | (F.col("p") != F.col("s")) | (F.col("m") != F.col("s") - 1)
    return each.agg(F.count_if(bad).alias("breaches"))


QUERIES = {
    "p3_found": lambda spark, d: split.oversized_plans(table(spark, d, "batch_plans", spread=True)),
    "p3_pieces": lambda spark, d: split.split_oversized(table(spark, d, "batch_plans", spread=True)),
    "p3_rejoined": lambda spark, d: _rejoined(split.split_oversized(_plans(spark, d))),
    "p5_found": lambda spark, d: scans.scan_repairs(table(spark, d, "batch_contexts", spread=True)),
    "p5_paragraphs": lambda spark, d: scans.repaired_texts(table(spark, d, "batch_contexts", spread=True)),
    "p6_packed": lambda spark, d: packing.packed(_docs(spark, d)),
    "p6_containers": lambda spark, d: packing.containers(packing.packed(_docs(spark, d))),
    "p6_loss_limited": lambda spark, d: packing.packed(_docs(spark, d), loss_capacity=LOSS_LIMIT),
    "p6_all_limits": lambda spark, d: packing.packed(_docs(spark, d), **ALL_LIMITS),
    "p6_summary": lambda spark, d: packing.summary(packing.packed(_docs(spark, d), **ALL_LIMITS), **ALL_LIMITS),
    "p6_coverage": lambda spark, d: _coverage(packing.packed(_docs(spark, d))),
    "p6_breaches": lambda spark, d: _kept(packing.packed(_docs(spark, d), **ALL_LIMITS), **ALL_LIMITS),
    "p7_found": lambda spark, d: leaks.leaked_passages(_docs(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id"),
    "p7_passages": lambda spark, d: leaks.leaked_passages(_docs(spark, d), table(spark, d, "eval_items")),
    "p7_report": lambda spark, d: leaks.leak_report(_docs(spark, d), table(spark, d, "eval_items")),
    "p8_found": lambda spark, d: canonical.look_alike_pairs(_docs(spark, d)),
    "p8_links": lambda spark, d: canonical.look_alike_links(_docs(spark, d)),
    "p8_classes": lambda spark, d: canonical.look_alike_classes(_docs(spark, d)),
    "p8_canonical": lambda spark, d: canonical.canonical_texts(_docs(spark, d)),
}

# The letters that are drawn alike, listed for the SQL on their own, by the ordinary letter that they equal.
_DRAWN_ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "L": "Լ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е",
    "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ", "u": "ս", "w": "ԝ", "x": "х", "y": "уү", "-": "‐‑",
}


def _canonical_sql(text: str) -> str:
    """The consistent form for texts whose folded letters stand alone, as all in these tables do."""
    pairs = [(other, plain) for plain, others in _DRAWN_ALIKE.items() for other in others]
    pairs += [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    pairs += [(blank, " ") for blank in "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"]
    sides = ["".join(p[k] for p in pairs).replace("'", "''") for k in (0, 1)]
    out = f"translate({text}, '{sides[0]}', '{sides[1]}')"
    for read, drawn in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{read}', '{drawn}')"
    return f"nfc_normalize(regexp_replace({out}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g'))"


_FORMS = f"forms AS (SELECT doc_id, text, {_canonical_sql('text')} AS look FROM documents WHERE text IS NOT NULL)"
_SHINGLES = f"""words AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower({_canonical_sql('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower({_canonical_sql('text')}), '[\\p{{L}}\\p{{N}}]+') FROM eval_items WHERE text IS NOT NULL),
shingles AS (SELECT side, id, i - 1 AS start, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM words)),
starts AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.start FROM (SELECT * FROM shingles WHERE side = 'd') d
  JOIN (SELECT DISTINCT id, s FROM shingles WHERE side = 'i') i USING (s)),
islands AS (SELECT doc_id, item_id, count(*) AS n, min(start) AS a FROM (
  SELECT *, start - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY start) AS island FROM starts) GROUP BY doc_id, item_id, island),
passages AS (SELECT doc_id, item_id, sum(n)::INT AS shingles, (max(n) + 11)::INT AS longest_words, min(a)::INT AS first_word FROM islands GROUP BY ALL)"""

ORACLES = {
    "p3_found": r"""SELECT DISTINCT plan_id FROM batch_plans
WHERE len(regexp_extract_all(raw_content, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f]')) > clean_token_target""",
    "p3_rejoined": r"""SELECT DISTINCT plan_id, len(regexp_extract_all(raw_content, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f]'))::BIGINT AS n_tokens,
md5(raw_content) AS text_hash, true AS within, true AS overlapped FROM batch_plans WHERE raw_content IS NOT NULL""",
    "p6_coverage": "SELECT doc_id, true AS whole, coalesce(text, '') <> '' AS placed FROM documents",
    "p6_breaches": "SELECT 0::BIGINT AS breaches",
    "p7_found": f"WITH {_SHINGLES} SELECT doc_id, item_id FROM passages",
    "p7_passages": f"WITH {_SHINGLES} SELECT doc_id, item_id, shingles, longest_words, first_word FROM passages",
    "p7_report": f"""WITH {_SHINGLES} SELECT item_id, count(doc_id) AS n_documents, coalesce(max(longest_words), 0) AS longest_words
FROM (SELECT DISTINCT item_id FROM eval_items) LEFT JOIN passages USING (item_id) GROUP BY ALL""",
    "p8_found": f"""WITH {_FORMS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM forms a JOIN forms b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_links": f"""WITH {_FORMS}, each AS (SELECT look, text, min(doc_id) AS text_id, count(*) AS n FROM forms GROUP BY ALL),
classes AS (SELECT look, min(text_id) AS class_id, sum(n) AS n, count(*) AS n_texts FROM each GROUP BY ALL)
SELECT f.doc_id, c.class_id, e.text_id, (c.n - e.n)::BIGINT AS n_links FROM forms f JOIN each e ON e.text = f.text JOIN classes c ON c.look = e.look WHERE c.n_texts > 1""",
    "p8_classes": f"""WITH {_FORMS} SELECT doc_id, min(doc_id) OVER c AS class_id, count(*) OVER c AS n_documents, n_texts
FROM forms JOIN (SELECT look, count(DISTINCT text) AS n_texts FROM forms GROUP BY look) USING (look) WINDOW c AS (PARTITION BY look)""",
    "p8_canonical": f"SELECT doc_id, {_canonical_sql('text')} AS canonical, {_canonical_sql('text')} IS DISTINCT FROM text AS changed FROM documents",
}
