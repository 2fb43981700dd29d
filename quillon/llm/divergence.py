"""Source divergence audit by a heavy-light split, in exact integers.

Every (lang, source) group gives each kept term of its language p = 1 + floor(SCALE * (count + 1) / (N + V)). How far a
group lies from another is the sum over all kept terms of f(p, q) = floor((p - q)^2 / q). A language's terms are split:

* *heavy* terms, in many of its groups, stand in dense numpy tiles of terms by groups; a tile adds all pairs of groups at once;
* *light* terms, in few groups, are posting lists. All of them are first added as if absent from both groups (one product for each pair of
  groups), then corrected: for a term in one group of the pair by the group's histogram of counts, and for a term in both by the
  pairs of its posting list, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), where p0 and q0 stand for no occurrence.

Every part is a sum of whole numbers, so the parts add up exactly. Words are counted in tasks first, so that a frequent
word or a large source sends a few rows from each task; no group of rows is gathered.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import release_memory, table

#: A term is a maximal run of these characters (fixed by the contract); of letters, A-Z alone are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for UTF-8 bytes, of which those of other characters are all 128 or more: every byte that is in no term becomes a space.
_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: What shares are counted in.
SCALE = 1_000_000_000
#: Cells of a dense tile, and group rows of it that one task compares.
CELLS, ROWS = 1 << 19, 64
#: Distinct (group, term) counts that a counting task holds before it sends them on.
HELD = 400_000


def _count_batches(batches):
    """Counts of (lang, source, term) and the documents that have it, as far as a task's memory holds them."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

    def flush():
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for start in range(0, len(terms), 20_000):
                part = terms[start : start + 20_000]
                n = pa.array(np.fromiter((counts[t] for t in part), np.int64, len(part)))
                d = pa.array(np.fromiter((docs[t] for t in part), np.int64, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), n, d], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().translate(_BYTES).split()
                if not words:
                    continue
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                size += len(counts) - before
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()
    release_memory()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that have the term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = rows.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals, since the product can leave 64 bits."""
    made = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast("decimal(38,0)")
    whole = F.call_function("div", made, (total + kept).cast("decimal(20,0)"))
    return (whole + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares up to SCALE + 1, which fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q).cast("long")


class Audit:
    """Kept terms with their postings, and the groups, both written to the shared folder.

    ``terms``: lang, term, n (in the language), postings (array of idx, n). ``groups``: lang, source, idx (0 on, by source), total, kept, p0
    (the share of a kept term without occurrence), n_groups. Null texts, languages and sources read as ''. Every row counts, repeated ones,
    too. A group without terms is a group; without kept terms V is 0 and nothing is apart. Other columns are not looked at."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3) -> None:
        seen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
        numbered = table(seen.withColumn("idx", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int")), "audit-groups")
        rows = counted(docs, text_col, lang_col, source_col).join(numbered, ["lang", "source"])
        whole = rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("idx", "n")).alias("postings"))
        self.terms = table(whole.filter(F.col("docs") >= min_docs).drop("docs"), "audit-terms")
        sums = self.terms.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.idx").agg(F.sum("x.n").alias("total"))
        langs = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
        full = numbered.join(sums, ["lang", "idx"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        full = full.withColumn("n_groups", F.count(F.lit(1)).over(W.partitionBy("lang")))
        p0 = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
        self.groups = table(full.withColumn("p0", p0), "audit-totals")

    def _posted(self) -> DataFrame:
        """lang, term, q (the language's share), idx, p (the group's share), p0, k (groups that have the term), n_groups."""
        rows = self.terms.select("lang", "term", F.col("n").alias("in_lang"), F.size("postings").alias("k"), F.explode("postings").alias("x")).select("lang", "term", "in_lang", "k", "x.idx", F.col("x.n").alias("n"))
        met = rows.join(self.groups.select("lang", "idx", "source", "total", "kept", "lang_total", "p0", "n_groups"), ["lang", "idx"])
        return met.select("lang", "term", "idx", "source", "k", "p0", "kept", "n_groups", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))

    def top_terms(self, ranks: int = 200) -> DataFrame:
        """The kept terms that a group has more of than its language: lang, source, item, value, rank up to ``ranks``. The rows of a group are cut
        to that many in each task before they meet."""
        rows = self._posted().filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)

    def pair_sums(self, light_groups: int = 8, light_share: float = 0.125) -> DataFrame:
        """lang, i, j (places of two groups), value: the distance of i from j. A term is heavy if more groups have it than both bounds say;
        where the line lies changes the work and not the sums."""
        lists = self.terms.select("lang", "term", F.col("postings.idx").alias("idx"), F.col("postings.n").alias("n"), F.size("postings").alias("k"))
        langs = self.groups.groupBy("lang").agg(F.first("n_groups").alias("n_groups"), F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("idx", "total", "p0"))).alias("groups"))
        langs = langs.filter("kept > 0")  # a row for each language, with three numbers for each of its groups
        heavy = F.col("k") > F.greatest(F.lit(light_groups), F.floor(F.col("n_groups") * light_share))
        split = lists.join(langs.select("lang", "n_groups"), "lang").withColumn("heavy", heavy)
        return self._dense(split.filter("heavy"), langs).unionByName(self._sparse(split.filter("NOT heavy"), langs)).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))

    def _dense(self, heavy: DataFrame, langs: DataFrame) -> DataFrame:
        """Heavy terms dealt to tiles by a hash; a tile's terms by all groups of the language is one matrix."""
        sizes = heavy.groupBy("lang").agg(F.count(F.lit(1)).alias("n_heavy"), F.max("n_groups").alias("g"))
        sizes = sizes.select("lang", F.ceil(F.col("n_heavy") * F.col("g") / CELLS).cast("int").alias("tiles"))
        dealt = heavy.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
        tiles = dealt.groupBy("lang", "tile").agg(F.collect_list(F.struct("idx", "n")).alias("rows"))
        tiles = tiles.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / ROWS).cast("int"))))
        return tiles.select("lang", "block", "groups", "kept", "rows").mapInArrow(_tile_batches, "lang string, i int, j int, value long")

    def _sparse(self, light: DataFrame, langs: DataFrame) -> DataFrame:
        kept = self.groups.filter("kept > 0").select("lang", "idx", "total", "kept", "p0")
        mine, other = kept.select("lang", F.col("idx").alias("i"), F.col("p0").alias("p0i")), kept.select("lang", F.col("idx").alias("j"), F.col("p0").alias("p0j"))
        pairs = mine.join(other, "lang").filter("i != j")  # what is asked for: every other group of a language
        absent = light.groupBy("lang").agg(F.count(F.lit(1)).alias("n_light"))
        base = pairs.join(absent, "lang").select("lang", "i", "j", (F.col("n_light") * apart(F.col("p0i"), F.col("p0j"))).alias("value"))
        posted = light.select("lang", F.explode(F.arrays_zip("idx", "n")).alias("x")).select("lang", "x.idx", "x.n")
        counts = posted.groupBy("lang", "idx", "n").agg(F.count(F.lit(1)).alias("terms")).join(kept, ["lang", "idx"])
        counts = counts.select("lang", "idx", "terms", "p0", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
        before = counts.join(other, "lang").filter("idx != j").select("lang", F.col("idx").alias("i"), "j", (F.col("terms") * (apart(F.col("p"), F.col("p0j")) - apart(F.col("p0"), F.col("p0j")))).alias("value"))
        after = counts.join(mine, "lang").filter("idx != i").select("lang", "i", F.col("idx").alias("j"), (F.col("terms") * (apart(F.col("p0i"), F.col("p")) - apart(F.col("p0i"), F.col("p0")))).alias("value"))
        single = before.unionByName(after).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        return base.unionByName(single).unionByName(self._both(light, kept))

    def _both(self, light: DataFrame, kept: DataFrame) -> DataFrame:
        """The pairs of each posting list. What a pair adds follows from the two counts, so pairs are counted by them first."""
        lists = light.filter("k > 1").select("lang", F.arrays_zip("idx", "n").alias("x"))
        pairs = lists.select("lang", "x", F.explode("x").alias("a")).select("lang", "a", F.explode("x").alias("b")).filter("a.idx != b.idx")
        joint = pairs.groupBy("lang", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.n").alias("ni"), F.col("b.n").alias("nj")).agg(F.count(F.lit(1)).alias("terms"))
        for k in "ij":
            own = kept.select("lang", F.col("idx").alias(k), F.col("total").alias("t"), F.col("kept").alias("v"), F.col("p0").alias(f"q{k}"))
            joint = joint.join(own, ["lang", k]).withColumn(f"p{k}", share(F.col(f"n{k}"), F.col("t"), F.col("v"))).drop("t", "v")
        p, p0, q, q0 = (F.col(c) for c in ("pi", "qi", "pj", "qj"))
        value = F.col("terms") * (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))
        return joint.groupBy("lang", "i", "j").agg(F.sum(value).alias("value"))

    def distances(self, **split) -> DataFrame:
        """lang, source, item (each other source of the language), value and rank: all pairs, also those at 0."""
        places = self.groups.select("lang", "idx", "source")
        mine, other = places.select("lang", F.col("idx").alias("i"), "source"), places.select("lang", F.col("idx").alias("j"), F.col("source").alias("item"))
        pairs = mine.join(other, "lang").filter("i != j").join(self.pair_sums(**split), ["lang", "i", "j"], "left").fillna(0, ["value"])
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def _shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The share of counts ``n`` in groups with ``total`` words; in Python's whole numbers where 64 bits don't hold the product."""
    if n.size and int(n.max()) > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(a) + 1) // (int(t) + kept) for a, t in zip(n.ravel().tolist(), np.broadcast_to(total, n.shape).ravel().tolist(), strict=True)], dtype=np.int64).reshape(n.shape)
    return 1 + SCALE * (n + 1) // (total + kept)


def _lists(column: pa.Array, i: int, *names: str) -> list[np.ndarray]:
    values = column[i].values
    return [values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def _sums(lang: str, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.int64())], names=["lang", "i", "j", "value"])


def _tile_batches(batches):
    """Sums over a tile's terms for a block of its groups against all groups."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, block, kept = (batch.column(c)[row].as_py() for c in (0, 1, 3))
            _, total, p0 = _lists(batch.column(2), row, "idx", "total", "p0")
            postings = batch.column(4)[row].values
            lists = postings.field("idx")
            lengths, where = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            n = postings.field("n").flatten().to_numpy()
            shares = np.repeat(p0[:, None], len(lengths), axis=1)  # a row for each group
            shares[where, np.repeat(np.arange(len(lengths)), lengths)] = _shares(n, total[where], kept)
            for i in range(block * ROWS, min((block + 1) * ROWS, len(p0))):
                far = shares[i] - shares
                value = (far * far // shares).sum(axis=1)
                j = np.flatnonzero(np.arange(len(p0)) != i)
                yield _sums(lang, np.full(len(j), i), j, value[j])
    release_memory()


def audit(docs: DataFrame, ranks: int = 200, **columns) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see :class:`Audit`. An empty table gives no rows."""
    made = Audit(docs, **columns)
    pairs, terms = made.distances().withColumn("part", F.lit("pair")), made.top_terms(ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
