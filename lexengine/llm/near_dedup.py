"""MinHash near-dedup by an inverted join on signature coordinates.

A text's signature holds the least hash of its shingles under each of COORDINATES permutations. Texts with one set are
a class, whose first member stands for it. A class is posted under its coordinate-value pairs. Two sets of similarity
0.8 agree in all but surely (1 - MISS) at least ``threshold()`` coordinates, so at most COORDINATES - threshold + 1 of
the rarest pairs need lists (the prefix); the more frequent ones are skipped, and their collisions are counted from the
signatures of the candidates that the lists bring together. Candidates above the threshold are confirmed on full sets.

No list is expanded into pairs. All members of a list first meet its first one; confirmed links make components. In the
lists that still hold several, members of different components whose signatures agree tie their components into
clusters, by spanning edges only. At last the members of each cluster come together once, in blocks, and those of
different components are compared by their sets, shortened to 32 bits an item, which can only raise a similarity. What
passes is confirmed on full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.llm import vectors as V
from lexengine.llm.common import keyed, released, skew_join, staged, tidy, unstaged
from lexengine.llm.components import connected_components

#: Coordinates that have lists, and those by which candidates are counted.
COORDINATES, COUNTED, MISS = 64, 192, 1e-9
#: Members of a list that are compared at once by their signatures, and of a cluster by their sets.
LIST_BLOCK, BLOCK = 4096, 256


def threshold(similarity: float = 0.8, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most coordinates that sets of this similarity agree in with probability 1 - miss."""
    below, t = 0.0, 0
    while (below := below + math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)) <= miss:
        t += 1
    return max(t, 1)


def shingles(column: pa.Array, size: int):
    """The set of each text as sorted 64-bit hashes."""
    for _, data, off in V.chunks(column):
        data = V.LOWER[data]
        start, end, row = V.words(data, off)
        word = V.spans(V.prefix(data), start, end)
        count = np.bincount(row, minlength=len(off) - 1)
        first = np.cumsum(count) - count
        n = max(0, len(word) - size + 1)
        rolled = word[:n].copy()
        for k in range(1, size):
            rolled = V.mixed(rolled * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
        for f, c in zip(first, count):
            if c >= size:
                yield np.unique(rolled[f : f + c - size + 1])
            elif c:
                whole = np.array([c], dtype=np.uint64)
                for k in range(f, f + c):
                    whole = V.mixed(whole * np.uint64(0x8CB92BA72F3D8DD7) + word[k : k + 1])
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COUNTED least values, 32 bits each, of every set."""
    seed = V.mixed(np.arange(1, 2 * COUNTED + 1, dtype=np.uint64)).astype(np.uint32)
    times, plus = seed[:COUNTED, None] | np.uint32(1), seed[COUNTED:, None]
    out = np.full((len(sets), COUNTED), 0xFFFFFFFF, dtype=np.uint32)
    for i, x in enumerate(sets):
        small = (x >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(small), 1024):
            np.minimum(out[i], (small[a : a + 1024] * times + plus).min(axis=1), out=out[i])
    return out


def _sign(size: int):
    @tidy
    def run(batches):
        for b in batches:
            sets = list(shingles(b["text"], size))
            sig = signatures(sets)
            n = np.array([len(x) for x in sets], dtype=np.int64)
            one = np.array([V.mixed(x + np.uint64(1)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
            two = np.array([V.mixed(x * np.uint64(3) + np.uint64(2)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
            listed = np.ascontiguousarray(sig[:, :COORDINATES]).ravel().view(np.int32)
            values = pa.FixedSizeListArray.from_arrays(pa.array(listed), COORDINATES).cast(pa.list_(pa.int32()))
            low = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["key"], pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), values, low],
                ["id", "key", "n", "one", "two", "sig", "low"],
            )

    return run


def _sets(size: int, short: bool = False):
    """Each text's set as bytes: items of 64 bits, or of 32 if short; these may stand there twice."""

    @tidy
    def run(batches):
        for b in batches:
            sets = ((x >> np.uint64(32)).astype(np.uint32) if short else x for x in shingles(b["text"], size))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "items"])

    return run


def _confirm(percent: int):
    @tidy
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), COUNTED)


def _agreeing(least: int, similarity: float):
    """Pairs whose signatures agree in enough coordinates, by their lowest bytes: a few more than do in whole ones."""

    @tidy
    def run(batches):
        for b in batches:
            n, m = b["na"].to_numpy(), b["nb"].to_numpy()
            ok = ((_bytes(b["sa"]) == _bytes(b["sb"])).sum(axis=1) >= least) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _groups(batches, most: int = 1 << 14, size: int = 1 << 23):
    """Tables of whole cells (token, i, j), from rows sorted by them; about most rows or size bytes in each."""
    held: list[pa.RecordBatch] = []

    def cell(table, k):
        return [table[c][k].as_py() for c in ("token", "i", "j")]

    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= most or sum(x.nbytes for x in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(len(table), dtype=bool)
            for c, v in zip(("token", "i", "j"), cell(table, len(table) - 1)):
                same &= table[c].to_numpy() == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(table, least: int, similarity: float):
    """Rows x and y of a table of cells, of different components, whose sizes and signatures allow the similarity; in parts."""
    comp, n, side = (table[c].to_numpy() for c in ("component", "n", "side"))
    sig = _bytes(table["low"])
    cells = [table[c].to_numpy() for c in ("token", "i", "j")]
    new = np.ones(len(comp), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cells], axis=0)
    start = np.append(np.flatnonzero(new), len(comp))

    def candidates():
        """Rows of one cell, in pairs; those of a large cell a strip of rows at a time."""
        for a, b in zip(start[:-1], start[1:]):
            own = side[a:b]
            if (own == 1).all():
                step = max(1, 200_000 // (b - a))
                for top in range(0, b - a, step):
                    x, y = np.nonzero(np.arange(top, min(top + step, b - a))[:, None] < np.arange(b - a)[None, :])
                    yield x + top + a, y + a
            else:
                left, right = np.flatnonzero(own == 0) + a, np.flatnonzero(own == 2) + a
                step = max(1, 200_000 // max(len(right), 1))
                for top in range(0, len(left), step):
                    part = left[top : top + step]
                    yield np.repeat(part, len(right)), np.tile(right, len(part))

    def together():
        todo, held = [], 0
        for found in candidates():
            todo.append(found)
            held += len(found[0])
            if held >= 100_000:
                yield np.concatenate(todo, axis=1)
                todo, held = [], 0
        if todo:
            yield np.concatenate(todo, axis=1)

    for x, y in together():
        ok = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
        x, y = x[ok], y[ok]
        for a in range(0, len(x), 20_000):
            ok = (sig[x[a : a + 20_000]] == sig[y[a : a + 20_000]]).sum(axis=1) >= least
            yield x[a : a + 20_000][ok], y[a : a + 20_000][ok]


def _spanning(least: int, similarity: float):
    """Edges between components that hold together those which signatures tie."""

    @tidy
    def run(batches):
        for table in _groups(batches):
            comp = table["component"].to_numpy()
            root: dict[int, int] = {}

            def top(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            out = []
            for x, y in _pairs(table, least, similarity):
                for a, b in np.unique(np.sort(np.stack([comp[x], comp[y]], axis=1), axis=1), axis=0).tolist():
                    if (p := top(a)) != (q := top(b)):
                        root[max(p, q)] = min(p, q)
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _similar(least: int, similarity: float, percent: int):
    """Pairs of different components whose shortened sets are similar."""

    @tidy
    def run(batches):
        for table in _groups(batches):
            key, n = table["key"].to_numpy(), table["n"].to_numpy()
            items = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["items"]]
            for xs, ys in _pairs(table, least, similarity):
                keep = []
                for x, y in zip(xs.tolist(), ys.tolist()):
                    at = np.searchsorted(items[y], items[x])
                    both = int((items[y][np.minimum(at, len(items[y]) - 1)] == items[x]).sum())
                    keep.append(100 * both >= percent * (n[x] + n[y] - both))
                if any(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(key[xs[keep]]), pa.array(key[ys[keep]])], ["a", "b"])

    return run


def _celled(rows: DataFrame, count: str, size: int) -> DataFrame:
    """rows (token, key, component, and others) in blocks of size of their token, which has count of them: sorted by token, i, j.

    Block i meets each block j >= i: the one on the left, the other on the right, and both with itself.
    """
    blocks = F.ceil(F.col(count) / size)
    mine = F.pmod(F.xxhash64("key"), blocks)
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1),
        lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), F.when(o == mine, 1).when(mine < o, 0).otherwise(2).alias("side")),
    )
    others = [c for c in rows.columns if c != count]
    out = rows.select(*others, F.explode(cells).alias("cell")).select("cell.i", "cell.j", "cell.side", *others)
    return out.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


class _Work:
    def __init__(self, own: DataFrame, size: int, similarity: float):
        self.own, self.size, self.percent, self.similarity = own, size, round(similarity * 100), similarity
        self.least, self.counted = threshold(similarity), threshold(similarity, COUNTED)
        signed = staged(own.mapInArrow(_sign(size), f"id {dict(own.dtypes)['id']}, key long, n long, one long, two long, sig array<int>, low binary"))
        self.signed = signed
        classes = signed.filter("n > 0").groupBy("one", "two", "n").agg(F.min(F.struct("key", "sig", "low")).alias("f"))
        self.classes = staged(classes.select("one", "two", "n", "f.key", "f.sig", "f.low"))
        self.links: list[DataFrame] = []

    def postings(self) -> DataFrame:
        """token, key: the rarest pairs of each class, of those that another has too."""
        tokens = self.classes.select("key", F.posexplode("sig").alias("k", "v"))
        tokens = tokens.select("key", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
        tokens = staged(tokens)
        shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
        # at most COORDINATES of a class come together here
        mine = skew_join(tokens, shared, ["token"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
        lists = F.lit(COORDINATES - self.least + 1) - (F.lit(COORDINATES) - F.size("all"))
        out = staged(mine.filter(lists > 0).select("key", F.explode(F.slice("all", F.lit(1), lists)).alias("x")).select("x.token", "key"))
        unstaged(tokens)
        return out

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose full sets are similar. Texts are joined alike at every size, as nodes grow with them."""
        pairs = staged(pairs)
        nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        sets = staged(self.own.select("key", "text").join(nodes.hint("merge"), "key", "left_semi").mapInArrow(_sets(self.size), "key long, items binary"))
        released(self.own.sparkSession)
        one = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
        two = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
        out = staged(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm(self.percent), "a long, b long"))
        unstaged(sets)
        unstaged(pairs)
        released(self.own.sparkSession)
        return out

    def components(self) -> DataFrame:
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        return staged(connected_components(links))

    def stars(self, postings: DataFrame) -> DataFrame:
        first = postings.groupBy("token").agg(F.min("key").alias("b"), F.count("*").alias("c")).filter("c > 1").select("token", "b")
        pairs = skew_join(postings, first, ["token"]).filter("key > b").select(F.col("key").alias("a"), "b").distinct()
        low = self.classes.select("key", "low", "n")
        a = low.select(F.col("key").alias("a"), F.col("low").alias("sa"), F.col("n").alias("na"))
        b = low.select(F.col("key").alias("b"), F.col("low").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_agreeing(self.counted, self.similarity), "a long, b long")

    def between(self, postings: DataFrame, components: DataFrame) -> DataFrame | None:
        """Pairs of different components that are similar by shortened sets; None if no list holds two components."""
        known = postings.join(components, postings["key"] == components["node"], "left").select("token", "key", F.coalesce("component", "key").alias("component"))
        known = staged(known)
        mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
        rows = staged(skew_join(known, mixed.select("token", "c"), ["token"]))
        if rows.isEmpty():
            return None
        low = self.classes.select("key", "n", "low")
        edges = staged(_celled(rows.join(low, "key"), "c", LIST_BLOCK).mapInArrow(_spanning(self.counted, self.similarity), "a long, b long"))
        if edges.isEmpty():
            return None
        released(self.own.sparkSession)
        clusters = staged(connected_components(edges)).select("node", F.col("component").alias("cluster"))
        members = staged(rows.select("key", "component").distinct().join(clusters, F.col("component") == F.col("node")).select("key", "component", F.col("cluster").alias("token")))
        sizes = members.groupBy("token").agg(F.count("*").alias("c"))
        sets = self.own.select("key", "text").join(members.select("key").hint("merge"), "key", "left_semi").mapInArrow(_sets(self.size, True), "key long, items binary")
        sets = staged(sets)
        released(self.own.sparkSession)
        whole = skew_join(members, sizes, ["token"]).join(low, "key").join(sets, "key")
        return _celled(whole, "c", BLOCK).mapInArrow(_similar(self.counted, self.similarity, self.percent), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(own: DataFrame, size: int, similarity: float) -> tuple[_Work, DataFrame]:
    work = _Work(own, size, similarity)
    released(own.sparkSession)
    postings = work.postings()
    released(own.sparkSession)
    work.links.append(work.confirmed(work.stars(postings)))
    components = work.components()
    if (pairs := work.between(postings, components)) is not None:
        work.links.append(work.confirmed(pairs))
        components = work.components()
    return work, components


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing; texts under size words have one shingle. Equal
    sets are linked, so repeated rows are; of rows that repeat even the id one is kept. component_id is the smallest id
    of those that can be reached. Other columns are not read, and an empty table gives an empty result.
    """
    own = keyed(docs, id_col, text_col)
    work, components = linked(own, size, similarity)
    heads = work.classes.select("one", "two", "n", F.col("key").alias("head"))
    heads = heads.join(components, heads["head"] == components["node"], "left").select("one", "two", "n", F.coalesce("component", "head").alias("component"))
    rows = work.signed.select("id", "key", "n", "one", "two").join(heads, ["one", "two", "n"], "left")
    rows = rows.select("id", "key", F.col("n").alias("n_shingles"), "component")
    if hasattr(own, "staged_at"):  # rows have keys other than their ids
        least = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("f"))
        rows = rows.join(least.select("component", F.col("f.id").alias("component_id"), F.col("f.key").alias("first_key")), "component", "left")
        rows = rows.select("id", "n_shingles", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("key") == F.col("first_key"), F.lit(True)).alias("kept"))
    else:
        rows = rows.select("id", "n_shingles", F.coalesce("component", "key").alias("component_id"))
        rows = rows.withColumn("kept", F.col("id") == F.col("component_id"))
    return rows.withColumnRenamed("id", id_col)


def without_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies, in docs' columns. Texts without words stay."""
    cols = docs.columns
    if docs.groupBy(id_col).count().filter(f"count > 1 OR `{id_col}` IS NULL").isEmpty():
        kept = near_duplicates(docs, id_col, text_col, size, similarity).filter("kept").select(F.col(id_col).alias("kept__"))
        return docs.join(kept, docs[id_col] == kept["kept__"], "left_semi")
    own = staged(docs.withColumn("uid__", F.monotonically_increasing_id()))
    kept = near_duplicates(own, "uid__", text_col, size, similarity).filter("kept").select("uid__")
    return own.join(kept, "uid__", "left_semi").select(*cols)
