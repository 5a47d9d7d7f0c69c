"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line, stripped of spaces at its ends, is dropped if an earlier line of the corpus, by (doc_id, position), is equal to
it or at edit distance 1. Lines shorter than min_chars, where one edit makes another word, go only as exact copies; empty
ones always stay.

Distinct lines are found by a 128-bit hash. Two lines at distance 1 whose shorter length is m agree in their first or
last m // 2 characters, so only lines that share such a half with another go on; halving what is left is repeated, each
time keeping rows whose shared part occurs twice. What remains of a line is then short: all its variants with one
character deleted are emitted as hashed keys, equal variants meet, the earliest of every meeting is found by minima
(never by pairs), and its edit distance is verified. The join is lossless: a variant of the remainder together with the
shared part is a variant of the whole line.

Defined cases: null doc_ids come last in order; a null text has no lines and stays null; rows equal in doc_id and text
are one document and all get its result; ties are resolved by (doc_id, hash of the text, position); all other columns
pass through untouched. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Work

LAST = (1 << 63) - 1
SPACES = " \t\r"
#: Rows of a counted side that a join may broadcast.
MOST_BROADCAST = 500_000


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def _half(side: str, rest: Column, size: Column, key: Column) -> Column:
    """Half of what is left (rest, of size characters or one more) as shared part; the other as the new rest."""
    cut = F.floor(size / 2).cast("int")
    shared, left = (rest.substr(F.lit(1), cut), rest.substr(cut + 1, F.length(rest))) if side == "head" else (rest.substr(F.length(rest) - cut + 1, cut), rest.substr(F.lit(1), F.length(rest) - cut))
    return F.struct(F.xxhash64(key, F.lit(side), shared).alias("key"), left.alias("rest"), (size - cut).cast("int").alias("size"))


def _shared(work: Work, rows: DataFrame) -> DataFrame:
    """Rows whose key another line has too."""
    hot = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key")
    return rows.join(work.sized(hot, MOST_BROADCAST, "hot"), "key", "left_semi")


class Lines:
    """Decisions on the lines of one table."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, halvings: int = 3):
        self.df, self.doc_id, self.text = df, doc_id, text
        self.work = Work(df.sparkSession, "lines")
        own = df.select(_order(F.col(doc_id)).alias("ord"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
        own = own.select("ord", "th", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).filter(F.length("line") > 0)
        n = F.length("line")
        keys = [_half(side, F.col("line"), n - k, (n - k).cast("long"))["key"] for k in (0, 1) for side in ("head", "tail")]
        found = self.work.save(own.select("ord", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.when(n >= min_chars, F.array(*keys)).alias("keys")), "found")
        place = F.struct("ord", "th", "pos")
        unique = self.work.save(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys")), "unique")
        met = _shared(self.work, unique.select("h1", "first", F.explode("keys").alias("key")))
        near = self.work.sized(met.select("h1", "first", "first.*").distinct(), MOST_BROADCAST, "near")
        texts = own.join(near, ["ord", "th", "pos"]).dropDuplicates(["first"])
        size = F.explode(F.array(F.length("line"), F.length("line") - 1)).alias("size")
        rows = texts.select("h1", "first", F.col("line").alias("rest"), size).withColumn("key", F.col("size").cast("long"))
        rows = self.work.save(rows, "rows")
        for k in range(halvings):
            halves = F.explode(F.array(*[_half(s, F.col("rest"), F.col("size"), F.col("key")) for s in ("head", "tail")])).alias("x")
            rows = self.work.save(_shared(self.work, rows.select("h1", "first", halves).select("h1", "first", "x.*")), f"half{k}")
        self.found, self.unique = found, unique
        self.near = self.work.save(self._earlier(rows), "near")

    def _earlier(self, rows: DataFrame) -> DataFrame:
        """first of every distinct line at distance 1 from an earlier one."""
        rest, longer = F.col("rest"), F.length("rest") > F.col("size")
        at = F.explode(F.when(F.length("rest") > 0, F.sequence(F.lit(1), F.length("rest")))).alias("at")
        one = rows.select("key", "first", "rest", longer.alias("longer"), at)
        gone = F.concat(rest.substr(F.lit(1), F.col("at") - 1), rest.substr(F.col("at") + 1, F.length("rest")))
        # same length: both lose the character at the same place; else the longer loses one and equals the shorter
        one = one.select("first", "rest", F.when(F.col("longer"), F.xxhash64("key", F.lit(0), gone)).otherwise(F.xxhash64("key", "at", gone)).alias("variant"), F.when(F.col("longer"), F.lit("long")).otherwise(F.lit("same")).alias("role"))
        none = rows.filter(~longer).select("first", "rest", F.xxhash64("key", F.lit(0), rest).alias("variant"), F.lit("short").alias("role"))
        variants = one.unionByName(none)
        best = F.struct("first", "rest")
        group = variants.groupBy("variant").agg(F.min(F.when(F.col("role") == "short", best)).alias("short"), F.min(F.when(F.col("role") != "short", best)).alias("other"), F.count("*").alias("n")).filter("n > 1")
        met = variants.join(group, "variant")
        partner = F.when(F.col("role") == "long", F.col("short")).otherwise(F.col("other"))
        met = met.withColumn("partner", partner).filter("partner.first < first").filter(F.levenshtein("rest", "partner.rest", 1) == 1)
        return met.select("first").distinct()

    def dropped(self) -> DataFrame:
        """ord, th, n_near and the sorted positions of a document's dropped lines."""
        copies = self.found.select("h1", "h2", "ord", "th", "pos").join(self.unique.filter("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).filter(F.struct("ord", "th", "pos") != F.col("first"))
        each = copies.select("ord", "th", "pos", F.lit(0).alias("near")).unionByName(self.near.select("first.*", F.lit(1).alias("near")))
        return self.work.sized(each.groupBy("ord", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.sum("near").alias("n_near")), MOST_BROADCAST, "dropped")

    def apply(self) -> DataFrame:
        """row: the table's columns; x: n_lines, n_removed, n_near and kept, the text without the dropped lines."""
        rows = self.df.select(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]).alias("row"))
        text = F.col(f"row.`{self.text}`")
        met = rows.select("row", _order(F.col(f"row.`{self.doc_id}`")).alias("ord"), F.xxhash64(text).alias("th")).join(self.dropped(), ["ord", "th"], "left")
        lines, none, gone = F.split(text, "\n", -1), F.lit(0), F.col("gone")
        # the runs of lines between dropped ones; bound to a variable, the lines are split once for all runs
        after = lambda k: F.when(k > 0, F.get(gone, k - 1) + 1).otherwise(0)
        until = lambda k, x: F.coalesce(F.get(gone, k), F.size(x))
        left = lambda x: F.flatten(F.transform(F.sequence(none, F.size(gone)), lambda k: F.slice(x, after(k) + 1, until(k, x) - after(k))))
        kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(F.array(lines), left)[0], "\n"))
        n = lambda c: F.greatest(F.coalesce(c, none), none).cast("long")
        return met.select("row", F.struct(n(F.size(lines)).alias("n_lines"), n(F.size("gone")).alias("n_removed"), n(F.col("n_near")).alias("n_near"), kept.alias("kept")).alias("x"))


def without_repeats(df: DataFrame, text: str = "text", n_chars: str = "n_chars", **more) -> DataFrame:
    """The table with the dropped lines cut out of its texts; a document that had lines and lost all goes."""
    out = Lines(df, text=text, **more).apply().filter("x.n_removed < x.n_lines OR x.n_lines = 0")
    return out.select(*[F.col("x.kept").alias(c) if c == text else F.when(F.col("x.n_removed") > 0, F.length("x.kept").cast("long")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_chars, kept_sha256."""
    kept = F.coalesce("x.kept", F.lit(""))
    rows = Lines(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **more).apply()
    return rows.select("row.doc_id", "x.n_lines", "x.n_removed", "x.n_near", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
