"""Near-duplicate groups by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

Every document has a signature of 32 MinHash values cut to 16 bits. Two signatures within distance 15 (differing values)
differ in at most one value of some chunk when they are split into 8 chunks of 4: the pigeonhole principle. So each
chunk gives four keys, one per value that may differ, and every such pair shares one of the 32 keys. A pair at
similarity 0.85 is farther apart than 15 with a chance of 3e-6.

Documents with equal sets are one class from the start. Work on a bucket (the classes of one key) never lists its pairs:

1. each class is compared with the smallest of its bucket; a sketch of 256 values must be close enough (``sketch_limit``);
2. buckets that still hold several groups are closed under "sketches are close", with groups merged as they are found,
   so only merging pairs come out; of buckets over ``BLOCK``, which a passage that many texts share makes, the members
   meet again by longer keys, six sketch values each, so that texts with little else in common part;
3. inside the groups of close sketches, links are confirmed on full sets; pairs already connected are skipped, and again
   only merging pairs come out.

Steps 2 and 3 deal a large group in blocks of ``BLOCK`` members, and each block also gets the same few pivots. So members
are united within their block, and blocks through the pivots, with rows in proportion to the group. What is then not in
the group's largest part meets every block: exact, and few rows unless many members are close to none.

Links give components by alternating large-star and small-star steps; tasks contract their links between them.

All tables here grow with the documents, so every join is a merge join by hint. Spark's estimate takes an exploded row for
one and a file for its rows in memory, and would broadcast tables too large for the driver where the input is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.llm.common import Memo, arrow_map, columns, stored, texts

VALUES, CHUNKS, SKETCH, BLOCK, PIVOTS = 32, 8, 256, 256, 8
HELD = 200_000  # ids whose links a task contracts at once
PACKED = 16  # shuffle partitions of links in a task
LONG = 6  # sketch values in a longer key: a pair at 0.85 shares none of the 42 with a chance of 2.4e-9, at 0.8 of 3e-6
WIDTH = VALUES // CHUNKS
U = np.uint64


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype="u8")


FACTORS, OFFSETS = _random(VALUES + SKETCH, 1) << U(1) | U(1), _random(VALUES + SKETCH, 2)


def sketch_limit(share: float) -> int:
    """Differing sketch values that a pair of similarity ``share`` exceeds with a chance of about 1e-5."""
    return int(np.ceil(SKETCH * (1 - share) + 4.3 * np.sqrt(SKETCH * share * (1 - share))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters the bits of 64-bit numbers."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Shingles:
    """Sets of hashed word shingles: sorted distinct 64-bit numbers."""

    def __init__(self, size: int):
        import xxhash

        self.size = size
        self.word = Memo(xxhash.xxh3_64_intdigest, 80_000)

    def of(self, text: str | None) -> np.ndarray:
        """Words are runs without ASCII white space, with A-Z in lower case. Fewer words than a shingle are one."""
        words = (text or "").encode().lower().split()
        hashes = np.fromiter(map(self.word.__getitem__, words), "u8", len(words))
        if not words:
            return hashes
        n = max(1, len(words) - self.size + 1)
        out = np.full(n, min(self.size, len(words)), "u8")
        for k in range(min(self.size, len(words))):
            out = _mixed(out * U(3) + hashes[k : k + n])
        return np.unique(out)


def minhash(values: np.ndarray, first: int, last: int, bits: int) -> np.ndarray:
    """The smallest image under each of the functions ``first`` to ``last``, cut to ``bits``."""
    images = values[None, :] * FACTORS[first:last, None] + OFFSETS[first:last, None]
    return _mixed(images.min(1)) >> U(64 - bits)


LINK = "a bigint, b bigint"
SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, signature array<int>"


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``SIGNED`` for every document; an empty set has neither hash nor signature."""

    def run(batch):
        import xxhash

        tool, n, digest, signature = Shingles(size), [], [], []
        for text in texts(batch):
            values = tool.of(text)
            n.append(len(values))
            digest.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
            signature.append(minhash(values, 0, VALUES, 16).astype("i4") if len(values) else None)
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "set_hash": digest, "signature": signature}

    return arrow_map(columns(docs, doc_id="bigint", text="string"), SIGNED, run)


def keys(signature: str = "signature") -> Column:
    """The keys of a signature: each chunk with each of its values left out."""
    out = []
    for chunk in range(CHUNKS):
        for gone in range(WIDTH):
            kept = [F.get(signature, F.lit(chunk * WIDTH + k)) for k in range(WIDTH) if k != gone]
            out.append(F.xxhash64(F.lit(chunk * WIDTH + gone), *kept))
    return F.array(*out)


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect what ``links`` (a, b) connect: those of each task become stars around its smallest ids.

    A link is two numbers, so a task takes several shuffle partitions, ``PACKED`` at most unless there are cores for
    fewer. It holds ``HELD`` ids at most; then it hands on their stars and begins anew.
    """
    spark = links.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[above]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, m) for x in list(parent) if (m := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
            if len(parent) > HELD:
                yield stars()
        yield stars()

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that links lead to.

    A round deals the links twice: each end moves on to that end's smallest neighbour (large star), then what an id is
    linked with joins the smallest of them (small star). Tasks contract what they hold, so few rounds are needed.
    """
    stars = stored(contracted(links.where("a <> b")), "stars")
    mark = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        mark = now
        least = stars.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = stars.join(least.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.withColumn("low", F.min("v").over(Window.partitionBy("u")))
        own = F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v"))
        stars = stored(contracted(small.select(own.alias("a"), F.col("low").alias("b"))), "stars")


def numbered(rows: DataFrame, blocks: str, name: str) -> DataFrame:
    """``rows`` with a block number below ``blocks``, by id."""
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int"))


def repeated(rows: DataFrame, blocks: str, name: str) -> DataFrame:
    """``rows`` once for every block number below ``blocks``."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))


def closure(rows: DataFrame, told: DataFrame, near: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) that, with the given labels, connect all members of a group that ``near`` connects.

    ``rows`` has group, id and label (members of one label are connected already), ``told`` what ``near`` reads of an id.
    ``near`` gets up to ``BLOCK`` members and a few more; where there is a column ``side``, pairs are of one member of
    side 1 and one of side 0.
    """
    count = (F.ceil(F.count("*") / BLOCK)).cast("int")
    dealt = numbered(rows.join(rows.groupBy("group").agg(count.alias("blocks")).hint("merge"), "group"), "blocks", "block")
    large = dealt.where("blocks > 1")
    few = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64(F.lit(1), "id"), "id"))
    pivots = large.withColumn("place", few).where(F.col("place") <= PIVOTS).withColumnRenamed("block", "own")
    pivots = repeated(pivots, "blocks", "block").where("block <> own").select("group", "id", "label", "block")
    told = told.hint("merge")
    first = dealt.select("group", "id", "label", "block").unionByName(pivots).join(told, "id")
    links = stored(by_group(first, ["group", "block"], LINK, near), "closing-links")
    large = stored(large, "large-groups")
    if large.isEmpty():
        return links
    joined = components(links.union(large.select("id", "label")))
    large = large.drop("label").join(joined.hint("merge"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    parts = large.groupBy("group", "label").agg(F.count("*").alias("n"))
    parts = parts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("of_most"))
    parts = parts.where("of_most < n").select("group", "most", F.ceil((F.col("n") - F.col("of_most")) / BLOCK).cast("int").alias("others"))
    open_ = stored(large.join(parts.hint("merge"), "group"), "open-groups")
    if open_.isEmpty():
        return links
    every = repeated(open_, "others", "part").withColumn("side", F.lit(0))
    rest = repeated(numbered(open_.where("label <> most").drop("block"), "others", "part"), "blocks", "block").withColumn("side", F.lit(1))
    names = ["group", "block", "part", "id", "label", "side"]
    second = every.select(names).unionByName(rest.select(names)).join(told, "id")
    return links.union(by_group(second, ["group", "block", "part"], LINK, near))


def parted(buckets: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows (group, id, label) of ``buckets``; those over ``BLOCK`` dealt anew by the longer keys of their members.

    Each member goes to its own keys once, however many large buckets it is in, and keys with one label are dropped.
    """
    sized = stored(buckets.join(buckets.groupBy("group").agg(F.count("*").alias("n")).hint("merge"), "group"), "sized-buckets")
    keys = [F.xxhash64(F.lit(at), F.substring("sketch", at + 1, LONG)) for at in range(0, SKETCH - LONG + 1, LONG)]
    large = sized.where(F.col("n") > BLOCK).select("id", "label").distinct().join(sketches.select("id", "sketch").hint("merge"), "id")
    large = stored(large.select(F.explode(F.array(*keys)).alias("group"), "id", "label"), "long-keys")
    several = large.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return sized.where(F.col("n") <= BLOCK).drop("n").unionByName(large.join(several.select("group").hint("merge"), "group"))


def by_group(rows: DataFrame, names: list[str], schema: str, pairs: Callable) -> DataFrame:
    """Bring the rows of each group of ``names`` together and let ``pairs`` turn each group's table into rows (a, b)."""
    dealt = rows.repartition(*names).sortWithinPartitions(*names)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            named = [np.asarray(batch.column(n)) for n in names]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in named], axis=0)) + 1 if batch.num_rows else []
            bounds = [0, *edges, batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                key = tuple(x[a] for x in named)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for group in groups(batches):
            for x, y in pairs(group):
                a.append(x)
                b.append(y)
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, schema)


class Roots:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray):
        _, first = np.unique(labels, return_inverse=True)
        lowest = np.full(first.max() + 1, len(labels))
        np.minimum.at(lowest, first, np.arange(len(labels)))
        self.root = lowest[first]

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        self.root[self.root == max(a, b)] = min(a, b)


def merging(group: pa.Table, limit: int, percent: int, exact: bool) -> list[tuple[int, int]]:
    """Pairs that merge groups: close sketches and, if ``exact``, full sets that are similar enough."""
    ids = np.asarray(group.column("id"))
    roots = Roots(np.asarray(group.column("label")))
    if roots.root.max() == 0:
        return []
    order = np.argsort(ids, kind="stable")
    sizes = np.asarray(group.column("n_shingles"))
    sketches = np.stack([np.frombuffer(x.as_py(), "u1") for x in group.column("sketch")])
    side = np.asarray(group.column("side")) if "side" in group.column_names else None
    sets: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(group.column("shingles")[int(i)].as_py(), "<u8")
        return sets[i]

    out = []
    for at, i in enumerate(order):
        if side is None:
            rest = order[at + 1 :]
        elif side[i]:
            rest = order[side[order] == 0]
        else:
            continue
        rest = rest[roots.root[rest] != roots.root[i]]
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[100 * low >= percent * high]
        if not len(rest):
            continue
        far = np.count_nonzero(sketches[rest] != sketches[i], axis=1)
        rest = rest[far <= limit][np.argsort(far[far <= limit], kind="stable")]
        for j in rest:
            if roots.root[i] == roots.root[j]:
                continue
            if exact:
                both = len(np.intersect1d(full(i), full(j), assume_unique=True))
                if 100 * both < percent * (sizes[i] + sizes[j] - both):
                    continue
            roots.join(i, j)
            out.append((int(ids[i]), int(ids[j])))
    return out


def described(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, sketch, shingles) of the wanted classes, from the texts of their documents; ``wanted`` has id,
    doc and set_hash."""
    rows = columns(docs, doc_id="bigint", text="string").join(wanted.hint("merge"), F.col("doc_id") == F.col("doc"))

    def run(batch):
        import xxhash

        tool, made = Shingles(size), {"id": [], "n_shingles": [], "sketch": [], "shingles": []}
        for i, text, digest in zip(batch.column("id"), texts(batch), batch.column("set_hash"), strict=True):
            values = tool.of(text)
            if xxhash.xxh3_128_digest(values.tobytes()) != digest.as_py():
                continue  # another text of this doc_id
            made["id"].append(i.as_py())
            made["n_shingles"].append(len(values))
            made["sketch"].append(minhash(values, VALUES, VALUES + SKETCH, 8).astype("u1").tobytes())
            made["shingles"].append(values.astype("<u8").tobytes())
        return made

    schema = "id bigint, n_shingles bigint, sketch binary, shingles binary"
    return arrow_map(rows.select("id", "text", "set_hash"), schema, run).dropDuplicates(["id"])


def same_document(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each ``doc_id`` that stands for several texts."""
    several = full.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low <> high")
    rows = full.join(several.select("doc_id").hint("merge"), "doc_id").select("doc_id", "set_hash").distinct()
    rows = rows.join(classes.hint("merge"), "set_hash")
    least = rows.groupBy("doc_id").agg(F.min("id").alias("b"))
    return rows.join(least.hint("merge"), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")


def linked(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents whose shingle sets are similar.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles;
    ``component_id`` is the smallest ``doc_id`` that links lead to. A text of fewer words is one shingle; null, empty
    and blank texts have no shingles and are linked with nothing. Rows of one ``doc_id`` that have words count as one
    document, whatever their texts: what is linked with any of them is linked with all. A null ``doc_id`` is linked with
    nothing and kept. Texts are used whole.
    """
    limit = sketch_limit(percent / 100)
    rows = stored(signed(docs, size), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_hash", "signature").agg(F.min("doc_id").alias("doc"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("id", F.explode(keys()).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(keyed.join(buckets.hint("merge"), "key"), "bucket-members")
    wanted = members.select("id").distinct().join(classes.select("id", "doc", "set_hash").hint("merge"), "id")
    told = stored(described(docs, wanted, size), "described")
    sketches = told.select("id", "n_shingles", "sketch")

    pairs = members.where("id <> center").select("id", "center").distinct()
    others = sketches.select(*[F.col(c).alias(f"{c}_2") for c in sketches.columns]).hint("merge")
    pairs = pairs.join(sketches.hint("merge"), "id").join(others, F.col("center") == F.col("id_2"))

    def close(batch):
        a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), "u1").reshape(-1, SKETCH) for c in ("sketch", "sketch_2"))
        n, m = (np.asarray(batch.column(c)) for c in ("n_shingles", "n_shingles_2"))
        near = (np.count_nonzero(a != b, axis=1) <= limit) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        return {c: pa.array(np.asarray(batch.column(old))[near]) for c, old in (("a", "id"), ("b", "center"))}

    stars = stored(arrow_map(pairs, LINK, close), "close-pairs")
    labels = components(stars)
    labelled = members.join(labels.hint("merge"), "id", "left").select(F.col("key").alias("group"), "id", F.coalesce("component", "id").alias("label"))
    labelled = stored(labelled, "bucket-labels")
    open_ = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    buckets = stored(parted(labelled.join(open_.select("group").hint("merge"), "group"), sketches), "open-buckets")
    more = closure(buckets, sketches, lambda g: merging(g, limit, percent, exact=False))
    near = components(stored(stars.union(more), "close-pairs"))

    groups = stored(near.select(F.col("component").alias("group"), "id", F.col("id").alias("label")), "near-groups")
    links = closure(groups, told, lambda g: merging(g, limit, percent, exact=True))
    found = components(stored(links.union(same_document(full, classes)), "links"))

    of_class = classes.join(found.hint("merge"), "id", "left").select("set_hash", "doc", F.coalesce("component", "id").alias("component"))
    of_class = stored(of_class, "class-components")
    smallest = of_class.groupBy("component").agg(F.min("doc").alias("component_id"))
    told = of_class.join(smallest.hint("merge"), "component").select("set_hash", "component_id").hint("merge")
    out = rows.join(told, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest ``doc_id``.

    Of several rows of that ``doc_id`` that have words one stays. Rows without words, and rows with a null ``doc_id``,
    all stay.
    """
    verdicts = linked(docs, size, percent).where("n_shingles > 0 AND doc_id IS NOT NULL")
    by_id = stored(verdicts.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    has_words = F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]")
    has_id = F.col("doc_id").cast("bigint").isNotNull() & F.coalesce(has_words, F.lit(False))
    # Rows that no verdict is about have a salt that no verdict has; so they are spread and never met.
    told = docs.select(
        F.when(has_id, F.col("doc_id").cast("bigint")).otherwise(0).alias("key"),
        F.when(has_id, 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(997))).alias("salt"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    apart = by_id.where("NOT kept OR n > 1").select(F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("salt"), "kept")
    # Verdicts grow with the documents: the same plan at every size, not a broadcast while they are few.
    met = told.withColumn("salt", F.col("salt").cast("bigint")).join(apart.hint("merge"), ["key", "salt"], "left")
    one = met.where("kept").groupBy("key").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return met.where("kept IS NULL").select("row").unionByName(one.select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
