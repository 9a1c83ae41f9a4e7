"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits meet half way: each emits all variants within one bit of itself, and
they share one. Distinct fingerprints emit their 65 variants; a variant's group is a mask of the bits by which its
members differ from it, so a group is one row of fixed size (its members follow from variant and mask) and no list is
collected. All members of a group lie within two bits of each other, so a star from its smallest member keeps every
connection; stars are made distinct, verified by XOR and joined into components.

near_duplicates and keep_first link documents by the likeness of their sets of five-word shingles instead, 0.8 or more, for which two
bits of 64 are far too near. They hash balls of the same radius around the PARTS parts, of 32 bits each, of a wider fingerprint
of each text's distinct pairs of words, and compare the shingles of what meets in some part, each group by a star. That joins
most of what is alike, but a fingerprint promises nothing about shingles, and a star's middle may be like neither of two texts
that are like each other. An exact search takes the rest: in one order of all shingles, rare ones first, two linked texts
share a shingle within their first fifth, early enough in both for the common ones to follow. Texts meet by these shingles unless
they stand in one component already, so that a group of near copies, joined by the balls, is not compared within itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, checkpointed_in_small_batches, checkpointed_lean, components, groups_for, parts_for, release, text_table, unused
from .substring_dedup import BLOCK_BYTES, ODD, U, Words, _mixed

#: Shingles whose bits are held at once; fingerprints whose variants one task emits, about.
STEP, POINTS = 1 << 16, 20_000
#: Parts of a wide fingerprint; words of what it is made of; bits of all parts by which like texts differ at most, about twice what is
#: usual at a likeness of 0.8; ids that are broadcast at most.
PARTS, PAIR, FAR, SMALL = 6, 2, 48, 500_000
#: Rows beyond which a shingle is a frequent one; files' bytes whose shingles one task counts, in how many
#: steps; first shingles, and pairs, that one task holds, about; what comparisons of shares allow for rounding.
OFTEN, COUNT_BYTES, AT_ONCE, MET, HELD, EPS = 16, 8 << 20, 8, 120_000, 100_000, 1e-6


def fingerprints(texts: Sequence[str | None], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints as signed numbers: a bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    out = np.zeros(len(texts), np.int64)
    hash64 = xxhash.xxh64_intdigest
    hashes: list[int] = []
    rows: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if not rows:
            return
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        size = np.array(sizes)
        begin = np.cumsum(size) - size
        count = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * count > size[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)
        hashes.clear(), rows.clear(), sizes.clear()

    def long(words: list[bytes]) -> int:
        """The same for a text of many shingles, in steps."""
        n, count = len(words) - shingle + 1, np.zeros(64, np.int64)
        for i in range(0, n, STEP):
            h = np.array([hash64(b" ".join(words[j : j + shingle]), 42) for j in range(i, min(n, i + STEP))], np.uint64)
            count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return int(np.packbits(2 * count > n).view(">i8")[0])

    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []  # one text at a time: a batch holds many megabytes
        n = len(words)
        if not n:
            continue
        if n - shingle > STEP:
            out[i] = long(words)
            continue
        if n <= shingle:
            hashes.append(hash64(b" ".join(words), 42))
        else:
            line = b" ".join(words)
            begin = [0]
            at = 0
            for w in words:
                at += len(w) + 1
                begin.append(at)
            hashes += [hash64(line[a : b - 1], 42) for a, b in zip(begin, begin[shingle:], strict=False)]
        rows.append(i)
        sizes.append(max(1, n - shingle + 1))
        if len(hashes) >= STEP:
            flush()
    flush()
    return out


def _in_blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts, some at a time, with the number of the first."""
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode().lower())
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def _digests(words: Words) -> list[bytes]:
    """A digest of each text's words."""
    ends = np.cumsum(words.size)
    spans = zip((ends - words.size).tolist(), ends.tolist(), strict=True)
    return [xxhash.xxh3_128_digest(words.buffer[words.begin[first] : words.begin[end - 1] + words.length[end - 1]] if end > first else b"") for first, end in spans]


def _distinct(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of k words, and their texts, in order of text and hash."""
    h, doc = words.runs(k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def wide_fingerprints(texts: Sequence[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Of each text a digest of its words, and PARTS numbers: a part's place in the upper 32 bits, its fingerprint in the lower.

    A bit is 1 if it is set in over half the hashes of the text's distinct runs of PAIR words.
    """
    digests: list[bytes] = []
    parts = np.zeros((len(texts), PARTS), np.int64)
    for begin, some in _in_blocks(texts):
        words = Words(some)
        digests += _digests(words)
        h, doc = _distinct(words, PAIR)
        count = np.zeros((len(some), 32 * PARTS), np.int32)
        for i in range(0, len(h), STEP):
            own = doc[i : i + STEP]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            for seed in range(0, PARTS, 2):
                bits = np.unpackbits(_mixed(h[i : i + STEP] * ODD + U(seed + 1)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                count[own[cuts], 32 * seed : 32 * (seed + 2)] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)[:, : 32 * (PARTS - seed)]
        many = np.bincount(doc, minlength=len(some))[:, None]
        values = np.packbits(2 * count > many, axis=1).view(">u4").astype(np.int64)
        parts[begin : begin + len(some)] = values | np.arange(PARTS) << 32
    return digests, parts


def likeness(a: str | None, b: str | None, shingle: int = 5) -> float:
    """The share of the distinct shingles of two texts (their 64-bit hashes) that both have; 1 for two texts without words."""
    words = Words([(t or "").encode().lower() for t in (a, b)])
    h, doc = words.runs(shingle)
    x, y = np.unique(h[doc == 0]), np.unique(h[doc == 1])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def with_fingerprint(docs: DataFrame, out: str = "fp", text_col: str = "text", shingle: int = 3) -> DataFrame:
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(fingerprints(s, shingle), dtype="int64")

    return docs.withColumn(out, fingerprint(F.col(f"`{text_col}`").cast("string")))


def ball_links(points: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that differ in one or two bits, enough of them to connect all that are linked."""
    bit = F.col("bit")
    flip = F.when(bit < 64, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    variants = points.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")).select(F.col("fp").bitwiseXOR(flip).alias("v"), flip.alias("flip"), (bit == 64).cast("int").alias("own"))
    groups = variants.groupBy("v").agg(F.bit_or("flip").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") > 1)
    members = F.expr("concat(if(own = 1, array(v), array()), transform(filter(sequence(0, 63), i -> (mask & shiftleft(1L, i)) != 0), i -> v ^ shiftleft(1L, i)))")
    stars = groups.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Words are lower-cased in A-Z only; a text of fewer words than a shingle is one shingle; without words, or null,
    the fingerprint is zero and linked like any other. component_id is the smallest doc_id reachable over links of two
    bits or fewer, its own included; rows whose id is null belong to a component but never name it (if no member has
    an id, it is null). Repeated rows come out as often as they come in.
    """
    marked = checkpointed_in_small_batches(with_fingerprint(text_table(docs, id_col, text_col), "fp", "text", shingle).select("doc_id", "fp"))
    points = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    spread = points.select("fp").repartition(parts_for(docs.sparkSession, points.count(), POINTS), "fp")  # by what will be emitted, not by what is read
    roots = components(ball_links(spread))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _near_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of documents that meet: those that share a part with its smallest document, and the smallest of parts that differ in one or two bits.

    nodes: (rep, node), a row for each document and part.
    """
    led = checkpointed_lean(nodes.groupBy("node").agg(F.min("rep").alias("lead"), F.max("rep").alias("most")))
    shared = nodes.join(led.where("lead < most").select("node", "lead"), "node").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    bit = F.col("bit")
    spread = led.select("node").repartition(parts_for(nodes.sparkSession, led.count(), 2 * POINTS), "node")
    flags = spread.select("node", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bit")).select(F.when(bit < 32, F.col("node").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).otherwise(F.col("node")).alias("v"), F.expr("shiftleft(1L, bit)").alias("flag"))
    groups = flags.groupBy("v").agg(F.bit_or("flag").alias("mask")).where(F.bit_count("mask") > 1)
    members = F.expr("transform(filter(sequence(0, 32), i -> (mask & shiftleft(1L, i)) != 0), i -> if(i = 32, v, v ^ shiftleft(1L, i)))")
    stars = groups.select(members.alias("m")).select(F.array_min("m").alias("x"), F.explode("m").alias("y")).where("x <> y").distinct()
    ends = [led.select(F.col("node").alias(n), F.col("lead").alias(c)) for n, c in (("x", "a"), ("y", "b"))]
    across = stars.join(ends[0], "x").join(ends[1], "y").select("a", "b")
    return shared.unionAll(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _codes(h: np.ndarray, groups: int) -> np.ndarray:
    """What shingles are counted by: a group above 32 bits of the hash. Two that share a code are only put in order together."""
    return (h >> U(40)) % U(groups) << U(32) | h & U(0xFFFFFFFF)


def frequent_shingles(texts: DataFrame, shingle: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order, of shingles that stand in more than OFTEN rows, and in how many (copies within one batch count once).

    All rows are counted. Of more than SMALL codes the most frequent are returned, cut between two powers of 2 ** 0.25. Whatever is
    missing is taken for a rare one, which costs time and no link.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in _in_blocks(batch.column(0).to_pylist()):
                words = Words(some)
                h, doc = _distinct(words, shingle)
                digests = _digests(words)
                codes = np.sort(_codes(h[np.isin(doc, list({d: i for i, d in enumerate(digests)}.values()))], groups))
                cuts = np.searchsorted(codes, np.arange(groups + 1, dtype=U) << U(32))
                low = codes.astype("<u4")
                some_in = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some_in, pa.int32()), pa.array([low[cuts[g] : cuts[g + 1]].tobytes() for g in some_in.tolist()], pa.binary())], ["g", "low"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for g, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(g, []).append(low)
        while held:  # a group at a time, as a worker keeps the memory that it once had
            g, lows = held.popitem()
            low, n = np.unique(np.frombuffer(b"".join(lows), "<u4"), return_counts=True)
            codes = low[n > OFTEN].astype(U) | U(g << 32)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n[n > OFTEN])], ["code", "n"])

    flat = texts.select("text").mapInArrow(sent, "g int, low binary").repartition(-(-groups // AT_ONCE), "g")
    often = checkpointed_lean(flat.mapInArrow(counted, "code long, n long").withColumn("power", F.floor(4 * F.log2("n"))))
    kept, least = 0, None
    for power, n in sorted(often.groupBy("power").count().collect(), reverse=True):
        kept += n
        if kept > SMALL:
            break
        least = power
    if least is None:
        return np.empty(0, U), np.empty(0, np.int64)
    table = often.where(F.col("power") >= least).select("code", "n").toArrow()
    codes, n = table["code"].to_numpy().view(U), table["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def first_shingles(texts: Sequence[str | None], shingle: int, least: float, groups: int, often: tuple[np.ndarray, np.ndarray]) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """Of each text a digest of its words, how many distinct shingles it has, and the first of them: rare ones, then frequent ones by how many rows they stand in.

    There are so many that two texts share one of them if `least` of their shingles are common: whoever misses all of a text's
    first shingles has less than `least` of it.
    """
    digests: list[bytes] = []
    sizes: list[int] = []
    firsts: list[np.ndarray] = []
    codes, counts = often
    for _, some in _in_blocks(texts):
        words = Words(some)
        digests += _digests(words)
        h, doc = _distinct(words, shingle)
        if len(codes):
            own = _codes(h, groups)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            h = h[np.lexsort((h, np.where(codes[at] == own, counts[at], 0), doc))]
        size = np.bincount(doc, minlength=len(some))
        begin = np.cumsum(size) - size
        many = np.where(size > 0, size - np.ceil(least * size - EPS).astype(np.int64) + 1, 0)
        sizes += size.tolist()
        firsts += [h[i : i + n].view(np.int64) for i, n in zip(begin.tolist(), many.tolist(), strict=True)]
    return digests, sizes, firsts


def meeting(key: np.ndarray, rep: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs (smaller, larger) of texts of different roots that share a key, so early in both that `least` of their shingles may be common.

    size: how many shingles the text has; at: how many stand before the key. A pair may come out several times.
    """
    order = np.lexsort((size, key))
    key, rep, root, size, at = (x[order] for x in (key, rep, root, size, at))
    begin = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
    length = np.diff(np.append(begin, len(key)))
    mixed = np.minimum.reduceat(root, begin) < np.maximum.reduceat(root, begin) if len(begin) else np.empty(0, bool)
    end = np.repeat(begin + length, length)
    k = np.flatnonzero(np.repeat(mixed, length))
    step, n, held = 0, 0, []
    while len(k):
        step += 1
        k = k[k + step < end[k]]
        k = k[size[k] >= least * size[k + step] - EPS]  # sizes go up, so that what is too short now remains so
        o = k + step
        ok = (root[k] != root[o]) & (np.minimum(size[k] - at[k], size[o] - at[o]) >= least / (1 + least) * (size[k] + size[o]) - EPS)
        a, b = rep[k[ok]], rep[o[ok]]
        held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        n += len(a)
        if n > HELD:
            yield np.unique(np.concatenate(held), axis=0)
            n, held = 0, []
    if n:
        yield np.unique(np.concatenate(held), axis=0)


def _missed(texts: DataFrame, reps: DataFrame, roots: DataFrame, shingle: int, least: float) -> DataFrame:
    """Distinct pairs (a, b) of reps of different roots, every one among them whose shingles are common by `least` or more."""
    groups = AT_ONCE * groups_for(texts, COUNT_BYTES)
    often = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle, groups))

    @F.pandas_udf("copy binary, size long, firsts array<long>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            digests, sizes, firsts = first_shingles(s, shingle, least, groups, often.value)
            yield pd.DataFrame({"copy": digests, "size": sizes, "firsts": firsts})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*([c.to_numpy() for c in batch.columns] for batch in batches), strict=True))
        for pairs in meeting(*map(np.concatenate, columns), least) if columns else ():
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    named = reps.join(roots, reps.rep == roots.node, "left").select("copy", "doc_id", "rep", F.coalesce("root", "rep").alias("root"))
    found = checkpointed_lean(texts.select("doc_id", first("text").alias("f")).select("doc_id", "f.*"))  # a filter here would run first twice, in two Python workers a task
    rows = int(found.agg(F.sum(F.size("firsts"))).first()[0] or 0)
    keys = found.join(named, ["copy", "doc_id"]).select("rep", "root", "size", F.posexplode("firsts").alias("at", "key"))
    dealt = keys.select("key", "rep", "root", "size", F.col("at").cast("long").alias("at")).repartition(parts_for(texts.sparkSession, rows, MET), "key")
    pairs = checkpointed_lean(dealt.mapInArrow(met, "a long, b long").distinct(), small=False)
    release(found)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of docs that has an id.

    Words are lower-cased in A-Z only. Texts of the same words are copies. Two texts are linked if `least` of their distinct
    shingles or more are common to both; a text of fewer words than a shingle is one shingle; texts without words, null ones
    too, are copies of each other. component_id is the smallest doc_id reachable over copies and links, its own included.
    No link between texts of different components is missed: what hashing leaves out, the exact search compares (shingles are told
    apart by 64 bits of hash). Repeated rows come out as often as they come in.
    """
    texts = text_table(docs, id_col, text_col).where("doc_id is not null")

    @F.pandas_udf("copy binary, parts array<long>")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            digests, parts = wide_fingerprints(s)
            yield pd.DataFrame({"copy": digests, "parts": list(parts)})

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y, shingle) for x, y in zip(a, b, strict=True)], dtype="float64")

    marked = checkpointed_lean(texts.select("doc_id", wide("text").alias("w")).select("doc_id", "w.copy", "w.parts"))
    least_id = F.min("doc_id").alias("doc_id")
    reps = checkpointed_lean(marked.groupBy("copy").agg(least_id, F.any_value("parts").alias("parts")).withColumn("rep", F.monotonically_increasing_id()))
    ends = [reps.select(F.col("rep").alias(c), F.col("parts").alias(f"p{c}"), F.col("copy").alias(f"c{c}"), F.col("doc_id").alias(f"d{c}")) for c in "ab"]
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)

    def known(pairs: DataFrame) -> DataFrame:
        return pairs.join(ends[0], "a").join(ends[1], "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ca, cb, da, db), checkpointed ones, that are linked: by their texts."""
        wanted = checkpointed_lean(pairs.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct())
        held = texts.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "doc_id", "left_semi")
        held = held.select("text", wide("text")["copy"].alias("copy")).dropDuplicates(["copy"])  # rows that share an id may hold other words
        held = checkpointed_lean(held)  # so that no task needs two Python workers at a time
        one, other = (held.select(F.col("copy").alias(f"c{c}"), F.col("text").alias(f"t{c}")) for c in "ab")
        links = pairs.join(one, "ca").join(other, "cb").select("a", "b", like("ta", "tb").alias("like"))
        found = checkpointed_lean(links)
        release(wanted)
        release(held)
        return found.where(F.col("like") >= least).select("a", "b")

    def still_apart(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends have different roots, with their roots ra and rb."""
        for c in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        return pairs.where("ra <> rb")

    names = ("a", "b", "ca", "cb", "da", "db")
    links = linked(checkpointed_lean(known(_near_pairs(reps.select("rep", F.explode("parts").alias("node")))).where(apart <= FAR).select(*names)))
    roots = checkpointed(components(links))
    missed = checkpointed_lean(known(still_apart(_missed(texts, reps, roots, shingle, least))).select(*names, "ra", "rb", apart.alias("apart")))
    if missed.limit(1).count():  # the nearest two of each two components first, as most of the other pairs need no comparison after that
        nearest = missed.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min_by(F.struct(*names), F.struct("apart", "a", "b")).alias("p"))
        nearest = checkpointed_lean(nearest.select("p.*"))
        links = links.union(linked(nearest))
        roots = checkpointed(components(links))
        others = checkpointed_lean(still_apart(missed.select(*names).join(nearest, ["a", "b"], "left_anti")).select(*names))
        if others.limit(1).count():
            links = links.union(linked(others))
            roots = checkpointed(components(links))
    rooted = reps.join(roots, reps.rep == roots.node, "left").select("copy", "doc_id", F.coalesce("root", "rep").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("copy", "component_id")
    return marked.select("doc_id", "copy").join(named, "copy").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of near_duplicates: that of its smallest doc_id. All columns, whatever their names.

    Rows without an id stay, as nothing tells them apart. Of rows that repeat the smallest doc_id, one stays.
    """
    parts = near_duplicates(docs, id_col, text_col)
    best = checkpointed(parts.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    name = unused(docs, "first")
    ids = best.select(F.col("doc_id").alias(name))
    kept = docs.join(F.broadcast(ids) if best.count() <= SMALL else ids, F.col(f"`{id_col}`") == F.col(name), "left_semi")
    if best.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
