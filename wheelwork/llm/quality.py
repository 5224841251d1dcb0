r"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are runs of other than ``\x20\x09-\x0D``; lines are split at ``\n``. Every
measure is a built-in expression, so the whole verdict is a projection: no shuffle,
no user functions, each text looked at alone and whole.

A word window that recurs is found by sorting (hash, place) pairs of all windows
of a text and comparing neighbours: n log n, also for very long texts. Windows are
compared by 64-bit hash within one text, so a chance match needs some 2**32 windows.

Cases: null text counts as empty (0 words: it fails the length rule); null in other
columns plays no part; repeated rows are judged alike; an empty table gives no rows;
input columns named like an output column go on as ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for on with as was by this be are from or an at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par au sur pas plus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
#: measure, least, most (None: unbounded). A text is kept if all hold.
RULES = [
    ("n_words", 20, 100_000_000),
    ("mean_word_chars", 1.5, 15.0),
    ("symbol_ratio", None, 0.25),
    ("stop_words", 2, None),
    ("upper_ratio", None, 0.6),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.3),
    ("table_line_ratio", None, 0.8),
]


BLANK = r"[\x20\x09-\x0D]"


def following(hashes: Column, by: int) -> Column:
    """Each element hashed with the one ``by`` places on; the last ``by`` have none."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, F.greatest(F.size(hashes), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every measure of RULES and its counts."""
    keep = docs.columns
    text = F.coalesce(F.col(text_column), F.lit(""))
    a = docs.select(*keep, text.alias("_t"), F.array_remove(F.split(text, BLANK + "+"), "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    # windows of 2, 4, then 8 words; those that would reach beyond the end are cut off
    b = a.select("*", following(F.col("_w"), 1).alias("_h")).select(*a.columns, following(F.col("_h"), 2).alias("_h")).select(*a.columns, following(F.col("_h"), 4).alias("_h"))
    b = b.select(*a.columns, F.slice("_h", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))).alias("_h"))
    recurs = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    c = b.select("*", F.when(recurs, F.array_sort(pairs)).alias("_p"))
    near = lambda p, i: F.coalesce(p["h"] == F.get("_p", i)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("_p", lambda p, i: near(p, i - 1) | near(p, i + 1)), lambda p: p["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"],
    )
    stops = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    d = c.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(stops, "_w")).cast("long").alias("stop_words"),
        F.size(F.filter("_l", lambda x: F.contains(x, F.lit(" | ")))).cast("long").alias("n_table_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return d.select(
        "*", per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_upper", "word_chars").alias("upper_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_word_ratio"), per("n_table_lines", "n_lines").alias("table_line_ratio"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "stop_words", "n_table_lines", "n_upper", "mean_word_chars", "symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_word_ratio", "table_line_ratio"]


def broken(rules=RULES) -> Column:
    """Names of the rules that a row breaks, in table order."""
    tests = []
    for name, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(name) < least)
        if most is not None:
            bad = bad | (F.col(name) > most)
        tests.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules=RULES, text_column: str = "text") -> DataFrame:
    """``docs`` with all measures, ``broken_rules`` and ``passes``."""
    out = measured(apart(docs, [*MEASURES, "broken_rules", "passes"]), text_column)
    return out.select("*", broken(rules).alias("broken_rules")).select("*", (F.size("broken_rules") == 0).alias("passes"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = judge(docs).select("*", failed.alias("base_failed"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("passes")).alias("kept"),
    )


def op5_sql(rules=RULES) -> str:
    tests = " AND ".join(f"{name} >= {least}" for name, least, _ in rules if least is not None)
    tests += "".join(f" AND {name} <= {most}" for name, _, most in rules if most is not None)
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gap AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS n FROM rep),
cov AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM gap GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_intersect([{stops}], ws)) AS stop_words, len(list_filter(ls, lambda x: contains(x, ' | '))) AS n_table,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper
  FROM w LEFT JOIN cov USING (doc_id)),
r AS (
  SELECT *, coalesce(wc, 0) AS word_chars, coalesce(wc / nullif(n_words, 0), 0.0) AS mean_word_chars,
    coalesce(n_symbols / nullif(wc, 0), 0.0) AS symbol_ratio, coalesce(n_upper / nullif(wc, 0), 0.0) AS upper_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_word_ratio,
    coalesce(n_table / nullif(n_lines, 0), 0.0) AS table_line_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept FROM r
"""
