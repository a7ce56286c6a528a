"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (``window`` consecutive words of an item; a shorter item that is not
empty is one window) are hashed, and the hashes sent to every executor as a broadcast hash set. Each document is
scanned once: its word windows are hashed and looked up, and only hits leave the scan, with their words,
which a join then compares with the windows themselves. A set of more than SLICE hashes is looked up in slices, one scan each.

Edge cases: null and empty texts have no words and are never hit; texts of any length are taken whole; rows whose ``id`` is null or repeats
are judged each by itself; an empty benchmark hits nothing; items without words are ignored; further
columns of either table are not looked at, and ``remove`` leaves them as they were, whatever their names. Texts are told
apart by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.session import cut

#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of one broadcast set: about 50 MB.
SLICE = 2_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once a row, wherever f uses it; a column of an earlier step can be computed again for each use."""
    return F.transform(F.array(value), f)[0]


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct (item, n, w, h): the words w of each window, how many, and their hash."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    b = b.select("item", "ws", F.least(F.size("ws"), F.lit(window)).alias("n"))
    b = b.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.slice(F.col("ws"), i, F.col("n")))).alias("w"))
    return b.select("item", "n", "w", F.xxhash64("w").alias("h")).distinct()


def text_keys(text: Column) -> list[Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit("2"), t).alias("_k2")]


def hits(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(docs' columns but text, n_words, at, n): a row with at null for each of docs (text and others), and one for each window of it, from the word at on, whose hash is that of a window of marks. Checkpointed."""
    # Driver side: how many different lengths (at most the window) and hashes the benchmark has.
    lengths = sorted(r["n"] for r in marks.select("n").distinct().collect())
    slices = max(1, -(-marks.select("h").distinct().count() // SLICE))
    names = [*(c for c in docs.columns if c != "text"), "n_words"]
    count = lambda n_words, n: F.greatest(n_words - n + 1, F.lit(0)).cast("int")

    def scanned(ws: Column) -> Column:
        """The number of words, and the hashes of all windows of each length behind a null."""
        of = lambda n: lambda i: F.xxhash64(F.slice(ws, i, n))
        each = [F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), count(F.size(ws), n)), of(n))).otherwise(F.array().cast("array<bigint>")) for n in lengths]
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("bigint")), *each).alias("hs"))

    rows = docs.withColumn("scan", bind(words(F.col("text")), scanned)).drop("text").select("*", "scan.n_words")
    rows = rows.select(*names, F.posexplode("scan.hs").alias("pos", "h"))  # words stay behind: they would be copied for every window
    many = {n: count(F.col("n_words"), n) for n in lengths}
    at, n, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for size, k in many.items():  # pos counts the windows of the first length, then those of the next
        mine = (F.col("pos") >= before) & (F.col("pos") < before + k)
        at, n, before = F.when(mine, F.col("pos") - before).otherwise(at), F.when(mine, F.lit(size)).otherwise(n), before + k
    out = None
    for k in range(slices):
        held = F.broadcast(marks.where(F.pmod("h", F.lit(slices)) == k).select(F.col("h").alias("held")).distinct())
        found = rows.join(held, F.col("h") == F.col("held"), "inner" if k else "left")
        found = found.where(F.col("held").isNotNull() | (F.col("pos") == 0)).select(*names, at.alias("at"), n.alias("n"))
        out = found if out is None else out.unionByName(found)
    return cut(out)


def verified(docs: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """(_k1, _k2, spots, items) of the texts of docs of which found has a window whose words are those of a window of marks. A text that many documents have is verified once."""
    spots = found.where("at IS NOT NULL").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("at", "n")).alias("spots"))
    texts = docs.select("_k1", "_k2", "text").join(spots, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.any_value("text").alias("text"), F.any_value("spots").alias("spots"))
    own = bind(words(F.col("text")), lambda ws: F.transform("spots", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.slice(ws, x["at"] + 1, x["n"]).alias("w"))))
    seen = texts.select("_k1", "_k2", F.explode(own).alias("x")).select("_k1", "_k2", "x.*")
    m = marks.groupBy("w").agg(F.collect_set("item").alias("held"))
    span = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    return seen.join(m, "w").groupBy("_k1", "_k2").agg(F.array_distinct(F.flatten(F.collect_list(span))).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a benchmark window; the items are those of which a
    window occurs. ``items_sha256`` is over the sorted item ids, comma-joined.
    """
    marks = benchmark_windows(benchmark, item, item_text, window)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *text_keys(F.col(text)))
    found = hits(docs, marks)
    out = found.where("at IS NULL").join(verified(docs, found, marks), ["_k1", "_k2"], "left")
    n_hit, items = F.coalesce(F.size("spots"), F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of documents that hold no benchmark window, with their columns as they were."""
    marks = benchmark_windows(benchmark, item, item_text, window)
    docs = documents.select(F.col(text).alias("text"), *text_keys(F.col(text)))
    bad = verified(docs, hits(docs, marks), marks).select("_k1", "_k2")
    rows = documents.select(F.struct("*").alias("_row"), *text_keys(F.col(text)))
    return rows.join(bad, ["_k1", "_k2"], "left_anti").select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
q AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN q USING (rid)
"""
