"""Fill-in-middle transformation with a learned rank index over the boundaries of a text's units.

A text is cut into units: a run of the letters A to Z in either case, or one other character. The offsets of
all boundaries (where each unit begins, and the end of the text) are held as a learned index from rank to
offset: line segments, each of which stays within REACH of every offset it covers, and for each boundary the
residual that is left, in one byte. Segments are fitted by a shrinking cone: from the first boundary of a
segment, the slopes that keep all boundaries so far within REACH; where none is left, a segment begins. A
cut is predicted from its rank by the segment that holds it and made exact by its residual.

Ranks of the cuts, the form of the output and the arrangement depend on doc_id and the number of units only,
so a rerun gives the same rows. Units are found and the index is built in blocks of BLOCK bytes of text (or
one longer text) per task; all else is expressions over columns. Nothing is shuffled.

Edge cases: null and empty texts have no units and are plain; a text that contains a marker is plain, so every
output can be taken apart again; a null doc_id counts as the text ''; repeated rows and repeated ids are rows
of their own, rows with the same id and text get the same result; a text of any length is cut whole; an empty
table gives no rows; further columns of the input are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment may be off, so that a residual (with rounding) fits in one byte; bytes of text indexed at a time.
REACH, BLOCK = 126, 1 << 22
LETTER = np.zeros(256, bool)
LETTER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True


class RankIndex(NamedTuple):
    """From rank to offset: segments (first rank, offset there, slope) and a residual for every rank."""

    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, rank, "right") - 1
        return self.offset[k] + np.rint(self.slope[k] * (rank - self.first[k])).astype(np.int64)

    def at(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residual[rank]


def fit(offsets: np.ndarray, reach: int = REACH) -> RankIndex:
    """The index of ascending offsets; no prediction is more than reach (and a rounding) off."""
    segments, s, n = [], 0, len(offsets)
    while s < n:
        low, high, j, step, fits = -np.inf, np.inf, s + 1, 512, True
        while j < n and fits:
            e = min(n, j + step)
            run, rise = np.arange(j - s, e - s), offsets[j:e] - offsets[s]
            lows = np.maximum(np.maximum.accumulate((rise - reach) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + reach) / run), high)
            crossed = lows > highs
            fits = not crossed[-1]
            k = e - j if fits else int(np.argmax(crossed))
            if k:
                low, high = lows[k - 1], highs[k - 1]
            j, step = j + k, 2 * step
        segments.append((s, offsets[s], (low + high) / 2 if j > s + 1 else 0.0))
        s = j
    first, offset, slope = (np.array(x) for x in zip(*segments, strict=True))
    index = RankIndex(first.astype(np.int64), offset.astype(np.int64), slope.astype(np.float64), np.zeros(0, np.int8))
    return index._replace(residual=(offsets - index.predict(np.arange(n))).astype(np.int8))


def boundaries(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the offsets in code points where its units begin, and its length."""
    texts = texts.cast(pa.large_utf8()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        own, begin = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        letter, later = LETTER[own], (own & 0xC0) == 0x80  # later: bytes of a character but its first
        start = ~later
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[begin[:-1][begin[:-1] < begin[1:]]] = True
        units, later = np.flatnonzero(start), np.flatnonzero(later)
        first = np.searchsorted(units, begin)
        chars, edge = units - np.searchsorted(later, units), begin - np.searchsorted(later, begin)
        for k in range(to - at):
            yield np.append(chars[first[k] : first[k + 1]], edge[k + 1]) - edge[k]
        at = to


CUTS = T.StructType().add("n", T.LongType()).add("a", T.LongType()).add("b", T.LongType())


@F.arrow_udf(CUTS)
def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """The number of units, and the offsets of the two boundaries that two numbers choose."""
    out = np.zeros((3, len(text)), np.int64)
    for k, (offsets, *h) in enumerate(zip(boundaries(text), h1.to_pylist(), h2.to_pylist(), strict=True)):
        out[0, k] = n = len(offsets) - 1
        out[1:, k] = fit(offsets).at(np.array(sorted(x % (n + 1) for x in h)))
    return pa.StructArray.from_arrays([pa.array(x) for x in out], [f.name for f in CUTS])


def rank_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of each text, to be kept: doc_id, n (units), first, offset, slope (arrays, one item a segment), residuals (a signed byte for each of the n + 1 boundaries)."""
    kind = T.StructType().add("n", T.LongType()).add("first", T.ArrayType(T.LongType())).add("offset", T.ArrayType(T.LongType())).add("slope", T.ArrayType(T.DoubleType())).add("residuals", T.BinaryType())

    @F.arrow_udf(kind)
    def built(texts: pa.Array) -> pa.Array:
        found = [fit(b) for b in boundaries(texts)]
        columns = [pa.array([len(x.residual) - 1 for x in found], pa.int64())]
        columns += [pa.array([getattr(x, c) for x in found], pa.list_(t)) for c, t in (("first", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64()))]
        return pa.StructArray.from_arrays([*columns, pa.array([x.residual.tobytes() for x in found], pa.binary())], kind.names)

    return documents.select(F.col(doc_id).alias("doc_id"), built(F.col(text).cast("string")).alias("x")).select("doc_id", "x.*")


def fill_in_middle(documents: DataFrame, plain: int = 10, spm: int = 20, seed: str = "1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n, form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    plain percent of the texts stay as they are, and spm percent of the others give the suffix first. The choices are the first four numbers of
    8 hexadecimal digits in the SHA-256 of seed, a colon and doc_id.
    """
    d = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    d = d.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(digest, 8 * k + 1, F.lit(8)), 16, 10).cast("long")))
    d = d.withColumn("cut", cuts("text", F.col("h")[0], F.col("h")[1]))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(m))
    whole = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= 100 - plain)
    form = F.when(whole, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    d = d.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.a").cast("int").alias("a"), F.col("cut.b").cast("int").alias("b"))
    part = lambda begin, size: F.when(F.col("form") != "plain", F.substr("text", begin + 1, size))
    d = d.select(
        "doc_id", "text", "n", "form", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b") - F.col("a")).alias("middle"), part(F.col("b"), F.length("text")).alias("suffix")
    )
    made = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    made = made.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    return d.select("doc_id", "n", "form", "prefix", "middle", "suffix", made.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from. Markers have a character in common only where they begin, and none where they end, so none can arise where a part meets a marker."""
    p = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return d.select("doc_id", "n", "form", *chars, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s
  from documents
), h as (
  select *, len(u) as n, list_transform([1, 9, 17, 25], lambda k: cast('0x' || substr(s, k, 8) as ubigint)) as h from d
), f as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from h
), p as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from f
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
