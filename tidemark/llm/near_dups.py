"""Near-duplicate classes: ProbMinHash signatures of weighted shingles, banding, exact verification.

Texts become bags of five-word shingles, weighted by how often each occurs. In a signature every
shingle is a Poisson process whose rate is its weight; each arrival falls on a random register, and
a register keeps the shingle that arrived first. Two texts agree on a register with probability
equal to their probability Jaccard similarity. Texts that agree on a band of registers share a
bucket; shared buckets give candidates; candidates are verified by their exact similarity, and
verified links form classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, table

BANDS, ROWS, WIDTH, SIMILARITY = 28, 5, 5, 0.8
_WORD = re.compile(r"\w+")
_G1, _G2, _G3, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9DDFEA08EB382D69)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _G1
    x = (x ^ (x >> np.uint64(30))) * _G2
    x = (x ^ (x >> np.uint64(27))) * _G3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, limit: int = 100_000):
        super().__init__()
        from xxhash import xxh64_intdigest

        self.hash, self.limit = xxh64_intdigest, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = self.hash(word)
        return h


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in small letters; texts that have none, by white space."""
    low = (text or "").lower()
    return _WORD.findall(low) or low.split()


def fingerprint(words: list[str]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(" ".join(words))


def shingles(words: list[str], hashes: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs; a shorter text is one shingle."""
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, len(w))):
        acc = acc * _BASE + w[i : i + n]
    return np.unique(mix(acc), return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that arrives first at each register.

    Arrivals are drawn in rounds; a shingle drops out as soon as its latest arrival is later than
    all registers hold, so that the work is about registers * log(registers) plus one draw for each.
    """
    n = len(keys)
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, dtype=np.uint64)
    time = np.zeros(n)
    # about the time at which every register has had an arrival, and so the arrivals of a shingle till then
    likely = registers * (np.log(registers) + 1) / weights.sum()
    many = min(int(likely * weights.max()) + 2, max(3, 8192 // n))
    draw = rounds = 0
    scale = np.uint64(32)
    while n:
        steps = mix(np.arange(draw, draw + many, dtype=np.uint64) * _G3)
        h = mix(keys[:, None] ^ steps)
        at = np.cumsum(np.log(((h >> scale).astype(np.float64) + 0.5) * 2.0**-32) / -weights[:, None], axis=1)
        at += time[:, None]
        time = at[:, -1]
        place = (((h & _LOW) * np.uint64(registers)) >> scale).astype(np.intp).ravel()
        at = at.ravel()
        before = first.copy()
        np.minimum.at(first, place, at)
        hit = np.flatnonzero((at == first[place]) & (at < before[place]))
        owner[place[hit]] = keys[hit // many]
        live = time < first.max()
        keys, weights, time = keys[live], weights[live], time[live]
        n = len(keys)
        draw += many
        rounds += 1
        many = max(2, many // 2 if rounds < 5 else 2048 // max(n, 1))
    return owner


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sig.reshape(bands, -1)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _G2
    for i in range(parts.shape[1]):
        acc = acc * _BASE + parts[:, i]
    return mix(acc).view(np.int64)


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common shingles of 1 / sum over all of max(a_j / a_i, b_j / b_i), in O(n log n).

    With equal weights it is the Jaccard similarity of the sets.
    """
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    # max(a_j / a_i, b_j / b_i) takes the a side where a_j / b_j >= a_i / b_i
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    from_ = np.searchsorted(ratio, ratio, side="left")
    above = a.sum() - np.concatenate([[0], np.cumsum(a)])[from_]
    below = np.concatenate([[0], np.cumsum(b)])[from_]
    return float((1 / ((above + only_a) / a + (below + only_b) / b)).sum())


def _sketch(docs: DataFrame) -> DataFrame:
    """id, h, fp, bands of every row; a row without words has a print of its own and no bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for b in batches:
            fps, bands = [], []
            for id_, h, text in zip(b["id"], b["h"], b["text"], strict=True):
                words = words_of(text)
                if words:
                    fps.append(fingerprint(words))
                    bands.append(band_keys(signature(*shingles(words, hashes))))
                else:
                    fps.append(xxh3_128_digest(f"\0{id_} {h}"))
                    bands.append(None)
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "fp": pd.Series(fps, dtype=object), "bands": pd.Series(bands, dtype=object)})

    return docs.mapInPandas(run, "id long, h long, fp binary, bands array<long>")


def _bags(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingles and weights of the texts in ``nodes``, and their bytes; texts are found by id and hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = [shingles(words_of(t), hashes) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "keys": [k.tobytes() for k, _ in out], "weights": [w.astype("<u4").tobytes() if (w > 1).any() else b"" for _, w in out], "bytes": [8 * len(k) for k, _ in out]})

    return docs.join(nodes, ["id", "h"]).select("node", "text").mapInPandas(run, "node binary, keys binary, weights binary, bytes long")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs a, b with their exact similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims = [probability_jaccard(*_unpacked(ka, wa), *_unpacked(kb, wb)) for ka, wa, kb, wb in zip(b["ka"], b["wa"], b["kb"], b["wb"], strict=True)]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "sim": np.asarray(sims, dtype=float)})

    one = bags.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))
    two = bags.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "ka", "wa", "kb", "wb").mapInPandas(run, "a binary, b binary, sim double")


def _unpacked(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, dtype=np.uint64)
    return k, np.frombuffer(weights, dtype="<u4") if weights else np.ones(len(k), dtype=np.uint32)


def spanning_links(loose: pd.DataFrame, every: pd.DataFrame, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between texts of ``loose`` and of ``every`` that join different classes, as few as needed.

    Both have node, label, keys, weights. Common shingles with all of ``every`` are counted at once; a
    pair that is joined already is passed over. A pair without repeated shingles whose set similarity
    is too small cannot be a link; the rest are verified exactly.
    """
    bags = [_unpacked(k, w) for k, w in zip(every["keys"], every["weights"], strict=True)]
    sizes = np.array([len(k) for k, _ in bags])
    repeats = np.array([len(w) > 0 for w in every["weights"]])
    keys = np.concatenate([k for k, _ in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    labels, nodes, out = list(every["label"]), list(every["node"]), []
    for node, label, k, w in zip(loose["node"], loose["label"], loose["keys"], loose["weights"], strict=True):
        mine = _unpacked(k, w)
        lo, hi = np.searchsorted(keys, mine[0], "left"), np.searchsorted(keys, mine[0], "right")
        span = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        common = np.bincount(owner[at], minlength=len(bags))
        jaccard = common / (len(mine[0]) + sizes - common)
        possible = np.flatnonzero((jaccard >= similarity - 1e-9) | ((repeats | (len(w) > 0)) & (common > 0)))
        for j in possible[np.argsort(-jaccard[possible], kind="stable")]:
            x, y = root(label), root(labels[j])
            if x != y and probability_jaccard(*mine, *bags[j]) >= similarity:
                parent[x] = y
                out.append((node, nodes[j]))
    return out


def similar_pairs(buckets: DataFrame, bags: DataFrame, scratch: Scratch, similarity: float, small: int, hubs: int = 4, block_bytes: int = 1 << 22) -> DataFrame:
    """Links (a, b) inside buckets, enough to connect every class; ``buckets`` has bucket and node.

    In a bucket of at most ``small`` texts all pairs are verified. In a larger one every text first
    meets the ``hubs`` texts that are in most large buckets, usually the originals of the copies;
    most texts are connected by that, at a cost that grows with the bucket and not with its square.
    Texts that are not in the main class of such a bucket then meet the whole bucket, in blocks of
    bounded bytes, and each pair of blocks gives only the links that join classes.
    """
    sized = scratch.put(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    rows = scratch.put(buckets.join(sized, "bucket"), "rows")
    few = rows.where(F.col("n") <= small)
    left, right = few.select("bucket", F.col("node").alias("a")), few.select("bucket", F.col("node").alias("b"))
    near = left.join(right, "bucket").where("a < b").select("a", "b")
    large = rows.where(F.col("n") > small).select("bucket", "node")
    if large.isEmpty():
        return scratch.put(_verified(near.distinct(), bags).where(F.col("sim") >= similarity).select("a", "b"), "links")
    often = scratch.put(large.groupBy("node").agg(F.count(F.lit(1)).alias("times")), "often")
    ranked = scratch.put(large.join(often, "node"), "ranked")
    top = ranked.groupBy("bucket").agg(F.max(F.struct("times", "node")).alias("h0"))
    chosen = scratch.put(top.select("bucket", F.col("h0.node").alias("hub")), "hubs-0")
    for i in range(1, hubs):
        others = ranked.join(chosen, (ranked["bucket"] == chosen["bucket"]) & (ranked["node"] == chosen["hub"]), "left_anti")
        more = others.groupBy("bucket").agg(F.max(F.struct("times", "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"))
        chosen = scratch.put(chosen.unionByName(more), f"hubs-{i}")
    meet = large.join(chosen, "bucket").where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    links = scratch.put(_verified(near.union(meet).distinct(), bags).where(F.col("sim") >= similarity).select("a", "b"), "links")
    known = components(links, scratch)
    member = large.join(known, "node", "left").join(bags.select("node", "bytes"), "node").select("bucket", "node", F.coalesce("label", "node").alias("label"), "bytes")
    member = scratch.put(member, "members")
    main = member.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).groupBy("bucket")
    main = main.agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes")).where("m.n < size")
    mixed = scratch.put(main.select("bucket", F.col("m.label").alias("main"), F.ceil(F.col("bytes") / block_bytes).cast("int").alias("parts")), "mixed")
    placed = member.drop("bytes").join(mixed, "bucket").join(bags, "node")
    placed = scratch.put(placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("bytes"), "placed")
    whole = F.sequence(F.lit(0), F.col("parts") - 1)
    columns = ["node", "label", "keys", "weights"]
    loose = placed.where(F.col("label") != F.col("main")).withColumn("other", F.explode(whole)).select("bucket", F.col("part").alias("i"), F.col("other").alias("j"), *columns)
    every = scratch.again(placed).withColumn("other", F.explode(whole)).select("bucket", F.col("other").alias("i"), F.col("part").alias("j"), *columns)

    def run(_: tuple, few_: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        found = spanning_links(few_, all_, similarity) if len(few_) and len(all_) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    keys = ("bucket", "i", "j")
    rest = scratch.put(loose.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(run, "a binary, b binary"), "rest")
    scratch.drop(placed)
    return links.unionByName(rest)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: one node of each connected class for all its nodes.

    In a round every node points at its least neighbour, pointers are followed to their end, and links
    are drawn anew between those ends. Classes of many links shrink to few nodes in a round or two.
    """
    edges = scratch.put(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        up = scratch.put(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")), "up")
        while True:
            jump = up.select(F.col("node").alias("at"), F.col("up").alias("further"))
            moved = scratch.put(up.join(jump, F.col("up") == F.col("at"), "left").select("node", "up", F.coalesce("further", "up").alias("next")), "up")
            done = moved.where(F.col("up") != F.col("next")).isEmpty()
            up = moved.select("node", F.col("next").alias("up"))
            if done:
                break
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = labels.join(up, F.col("label") == up["node"], "left").select(labels["node"], F.coalesce("up", "label").alias("label"))
        labels = scratch.put(labels, "labels")
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        drawn = edges.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        new = scratch.put(drawn, "edges")
        scratch.drop(edges)
        edges = new
        if edges.isEmpty():
            return labels


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's key: its id and the hash of its text. A row without an id goes by that hash, below all
    usual ids; null text counts as empty."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), _by_hash(h)), h


def _by_hash(h: Column) -> Column:
    return -F.shiftrightunsigned(h, 1) - 1


def _classes(docs: DataFrame, scratch: Scratch, similarity: float, small: int) -> tuple[DataFrame, DataFrame, bool]:
    """From id, h and text: the rows as id, h, class_id; the first row (id, h) of every class; whether ids repeat."""
    sketched = scratch.put(_sketch(docs), "sketches")
    repeated = not sketched.groupBy("id").count().where("count > 1").isEmpty()
    texts = scratch.put(sketched.groupBy(F.col("fp").alias("node")).agg(F.min(F.struct("id", "h")).alias("rep"), F.first("bands").alias("bands")), "texts")
    exploded = texts.select(F.explode("bands").alias("bucket"), "node")
    shared = scratch.put(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared")
    buckets = scratch.put(exploded.join(shared, "bucket"), "buckets")
    nodes = texts.join(buckets.select("node").distinct(), "node").select("node", "rep.id", "rep.h")
    bags = _bags(docs, nodes)
    bags = scratch.put(bags.dropDuplicates(["node"]) if repeated else bags, "bags")
    links = similar_pairs(buckets, bags, scratch, similarity, small)
    labels = components(links, scratch)
    scratch.drop(bags)
    scratch.drop(buckets)
    labelled = scratch.put(texts.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("rep").alias("rep"))
    name = F.col("rep.id")
    if repeated:  # of classes with one least id, that of the least text hash has it
        least = scratch.put(least, "least")
        taken = least.groupBy(F.col("rep.id").alias("id")).agg(F.min(F.struct("rep.h", "label")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "first")
        least = least.join(taken, F.col("rep.id") == F.col("id"), "left").drop("id")
        name = F.when(F.col("first").isNull() | (F.col("first.label") == F.col("label")), name).otherwise(_by_hash(F.xxhash64("label")))
    least = scratch.put(least.select("label", "rep", name.alias("class_id")), "class-names")
    named = scratch.put(labelled.select("node", "label").join(least.select("label", "class_id"), "label").select(F.col("node").alias("fp"), "class_id"), "named")
    return sketched.select("id", "h", "fp").join(named, "fp").select("id", "h", "class_id"), least.select("rep.id", "rep.h"), repeated


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, small: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id and class_id, the least id of its class.

    Texts whose words agree in order (case and marks aside) are one class without further ado; they
    are joined where they lie, so that huge groups of copies are one text from there on. Texts
    without words (null, empty) are classes of their own, but for repeated rows of one id and text.
    Ids may repeat and be null: a row counts by its id and text. A class whose least id is the least
    of another class, too, is named by a hash of its text instead, a number below -1.
    """
    id_, h = _key(id_col, text_col)
    keyed = docs.select(id_.alias("id"), h.alias("h"), F.col(text_col).alias("text"))
    return _classes(keyed, scratch or Scratch(docs.sparkSession), similarity, small)[0].select("id", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, small: int = 16) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; its columns stay.

    Rows without words are classes of their own and stay. Of rows that repeat both an id and a text
    one stays, and of rows with one id and different texts those that are first of their classes.
    """
    key, print_ = fresh(docs, "row_key", "text_hash")
    id_, h = _key(id_col, text_col)
    keyed = docs.select(id_.alias("id"), h.alias("h"), F.col(text_col).alias("text"))
    _, kept, repeated = _classes(keyed, Scratch(docs.sparkSession), similarity, small)
    kept = kept.select(F.col("id").alias("kept_id"), F.col("h").alias("kept_hash"))
    own = docs.withColumns({key: id_, print_: h})
    out = own.join(kept, (F.col(key) == F.col("kept_id")) & (F.col(print_) == F.col("kept_hash")), "left_semi")
    if repeated:
        out = out.dropDuplicates([key, print_])
    return out.drop(key, print_)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document; odd rows as ``classes`` says."""
    return classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
