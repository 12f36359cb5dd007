"""N-gram Jaccard join by PartEnum signatures: near duplicates as exact connected components.

Two documents link when the Jaccard similarity of their sets of distinct ``n``-word shingles is at
least ``percent`` / 100. The method, for sets of at least one shingle:

1. Sizes are cut into bands. A pair whose larger set lies in the band up to ``r`` differs in at most
   ``k = 2r (100 - percent) / (100 + percent)`` shingles. The shingle domain is hashed into
   ``k + 1 + spare`` partitions per band, so such a pair agrees on at least ``spare + 1`` of them.
   A set's projection on one partition is a signature; a set signs for its own band and for those
   of its possible larger partners. It leaves out its smallest projections, ``spare`` at most, as
   they say little: of the ``spare + 1`` agreed ones the largest is signed by both sets, so every
   linked pair shares a signature.
2. Signatures are dealt by hash, each partition of about ``ROWS_PER_TASK`` rows. In each bucket all
   members are paired with the first ``CENTRES`` members in the order of a hash, not all pairs.
3. Each set has a sketch: a bit for each of at least twice as many places as it has shingles (up to
   ``SKETCH_BITS``), the parity of the shingles hashed there. Two sets differ in at least as many
   shingles as their sketches in bits, so pairs whose sketches lie too far apart are excluded without
   a look at the texts. The others are confirmed on the whole shingle sets: first one for each member,
   with the smallest of its centres in the order of a hash, then those whose ends these links have not
   connected, so a family of near copies is confirmed in about as many pairs as it has members.
   Components are formed from confirmed links, and groups of members with a common first centre that
   are connected are done.
4. Members of such a group outside its largest component are strays. They meet all members of their
   group by sketches; of what is left the nearest pair of two components is confirmed first, then the
   pairs that are still not connected.
5. Groups of more than ``STRAYS`` strays, where this would grow with a square, go another way: the
   member of the largest component nearest to the centres, the medoid, is compared with all members
   of the group. With ``A`` and ``B`` the differences of two
   members from the medoid (shingles in one set only), the members differ in
   ``len(A) + len(B) - 2 len(A & B)`` shingles, so a linked pair shares at least
   ``t = (len(A) + len(B) - k) / 2`` of them, and, in any common order, one among the first
   ``len(A) - t + 1`` of ``A`` and the first ``len(B) - t + 1`` of ``B``. Shingles that the medoid
   lacks come first, they are rare; what most members of a group differ in is the medoid's own
   oddity and is taken out of it before. Only pairs of a stray that share so are confirmed; strays so
   near that ``t`` is 0 meet the members as near.

After this every pair of a bucket is confirmed, excluded by a bound, or already connected, without
comparing all pairs of a family.

Equal sets are represented by their smallest document from the start.

Nulls and ties: a null or empty text has an empty set and links with nothing. Rows that repeat a
document id are one node of the graph, and each gets a result row. A row without id gets
``component_id`` null and links with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import (
    components,
    drop_written,
    packed,
    settled,
    small_batches,
    unpacked,
)
from stayrate.llm.text import mix, mix_int, shingle_sets, text_slices

CENTRES = 2
BAND_GROWTH = 1.4
SETS_KEPT = 4000
SETS_BYTES = 1 << 25
PACKED_BYTES = 1 << 22
STRAYS = 4096
PIECE = 4096
SKETCH_BITS = 1 << 17
ROWS_PER_TASK = 2_000_000


def band_edges(largest: int) -> np.ndarray:
    """Upper ends of the size bands, growing by ``BAND_GROWTH``, up to ``largest`` or beyond."""
    edges = [1]
    while edges[-1] < largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return np.array(edges)


def most_different(size: int, percent: int) -> int:
    """Largest symmetric difference of a linked pair whose larger set has ``size`` elements."""
    return 2 * size * (100 - percent) // (100 + percent)


def spare_parts(different: int) -> int:
    return max(2, different * 3 // 10)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of a sorted set of fingerprints."""
    size = len(shingles)
    if not size:
        return np.zeros(0, np.uint64)
    largest = size * 100 // percent
    edges = band_edges(largest)
    out = []
    for band in range(*np.searchsorted(edges, [size, largest]) + np.array([0, 1])):
        different = most_different(int(edges[band]), percent)
        spare = spare_parts(different)
        parts = different + 1 + spare
        seed = mix_int(band + 1)
        mixed = mix(shingles ^ np.uint64(seed))
        part = ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        low = np.bincount(part, (mixed & np.uint64(0xFFFFFFFF)).astype(float), parts)
        other = mix(mixed) >> np.uint64(32)
        high = np.bincount(part, other.astype(float), parts)
        count = np.bincount(part, minlength=parts)
        keys = mix(
            low.astype(np.uint64)
            + high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            + mix(np.arange(parts, dtype=np.uint64) + np.uint64(seed))
        )
        out.append(keys[count >= np.partition(count, spare)[spare]])
    return np.concatenate(out)


def shingle_counts(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, low, high): set sizes and a 128-bit digest of the set (null if empty)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_shingles bigint, low bigint, high bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in text_slices(batch.column(1)) for s in shingle_sets(part, n)]
            sizes = np.array([len(s) for s in sets], np.int64)
            low = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            high = np.array(
                [mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets],
                np.uint64,
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(low, mask=sizes == 0),
                    pa.array(high, mask=sizes == 0),
                ],
                names=[id_col, "n_shingles", "low", "high"],
            )

    return docs.select(id_col, text_col).mapInArrow(count, schema)


def signature_rows(
    docs: DataFrame, n: int, percent: int, id_col: str, text_col: str
) -> DataFrame:
    """(sig, id) for every set; sets equal to one already signed in the same task are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in text_slices(batch.column(1)):
                keys, owners = [], []
                for i, shingles in enumerate(shingle_sets(part, n), part.first):
                    if not len(shingles):
                        continue
                    digest = (
                        mix(shingles).sum(dtype=np.uint64).tobytes()
                        + mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
                        .sum(dtype=np.uint64)
                        .tobytes()
                    )
                    if digest in signed:
                        continue
                    signed.add(digest)
                    found = signatures(shingles, percent)
                    keys.append(found.view(np.int64))
                    owners.append(np.full(len(found), ids[i]))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))],
                        names=["sig", "id"],
                    )

    rows = docs.filter(F.col(id_col).isNotNull()).selectExpr(
        f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text"
    )
    return rows.mapInArrow(sign, "sig bigint, id bigint")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, first, centre, member) of the buckets of a partition with several members.

    Buckets with the same members count once; ``first`` is the first of the centres.
    """
    columns = [
        (b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches
    ]
    if not columns:
        return
    sig, member = (np.concatenate(c) for c in zip(*columns))
    del columns
    order = np.argsort(sig)
    same = sig[order][1:] == sig[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if not len(order):
        return
    sig, member = sig[order], member[order]
    marks = mix(member.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    order = np.lexsort((marks, sig))
    sig, member, marks = sig[order], member[order], marks[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
    sig, member, marks = sig[keep], member[keep], marks[keep]
    begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(begin, len(sig)))
    bucket = mix(np.add.reduceat(marks, begin) + size.astype(np.uint64))
    _, one = np.unique(bucket, return_index=True)
    begin, size = begin[one], size[one]
    for place in range(CENTRES):
        chosen = np.flatnonzero(size > place + 1)
        for part in np.array_split(chosen, int(size[chosen].sum()) // (1 << 17) + 1):
            counts = size[part] - place - 1
            row = np.repeat(part, counts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(size[row].astype(np.int64)),
                    pa.array(member[begin[row]]),
                    pa.array(member[begin[row] + place]),
                    pa.array(member[begin[row] + place + 1 + other]),
                ],
                names=["size", "first", "centre", "member"],
            )


def row_runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first row, number of rows) of together about ``most`` bytes, one row at least."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(int(np.searchsorted(ends, before + most, "right")), first + 1)
        yield first, last - first
        first = last


def pairwise(
    pairs: DataFrame,
    texts: DataFrame,
    n: int,
    names: dict[str, pa.DataType],
    measure: Callable[[np.ndarray, np.ndarray], tuple],
) -> DataFrame:
    """(a, b, *names): ``measure`` of the two shingle sets of each pair (a, b).

    A task keeps sets for later pairs, ``SETS_KEPT`` or ``SETS_BYTES`` at most, besides those of the
    run of pairs at hand, whose packed texts take about ``PACKED_BYTES``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for whole in batches:
            sizes = sum(pc.binary_length(whole.column(i)).to_numpy() for i in (2, 3))
            for batch in (whole.slice(*run) for run in row_runs(sizes, PACKED_BYTES)):
                a, b = (batch.column(i).to_pylist() for i in range(2))
                wanted = {}
                for i, column in ((0, 2), (1, 3)):
                    for row, key in enumerate((a, b)[i]):
                        if key not in sets and key not in wanted:
                            wanted[key] = batch.column(column)[row].as_py()
                held = sum(s.nbytes for s in sets.values())
                if len(sets) + len(wanted) > SETS_KEPT or held > SETS_BYTES:
                    needed = {*a, *b}
                    sets = {key: value for key, value in sets.items() if key in needed}
                keys = list(wanted)
                for first, column in unpacked(pa.array(wanted.values(), pa.binary())):
                    for part in text_slices(column):
                        for i, shingles in enumerate(shingle_sets(part, n), first + part.first):
                            sets[keys[i]] = shingles
                values = list(zip(*(measure(sets[x], sets[y]) for x, y in zip(a, b))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1)]
                    + [pa.array(v, t) for v, t in zip(values or [[]] * len(names), names.values())],
                    names=["a", "b", *names],
                )

    sql = {pa.int64(): "bigint", pa.list_(pa.int64()): "array<bigint>"}
    schema = ", ".join(["a bigint, b bigint", *(f"{k} {sql[t]}" for k, t in names.items())])
    with_b = pairs.join(texts.selectExpr("id AS b", "packed AS text_b"), "b")
    both = with_b.join(texts.selectExpr("id AS a", "packed AS text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union of the two shingle sets."""

    def measure(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common, len(x) + len(y) - common

    return pairwise(pairs, texts, n, {"common": pa.int64(), "total": pa.int64()}, measure)


def differences(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, common, total, size, most, apart): how the set of ``b`` differs from that of ``a``.

    ``size`` belongs to ``b``, ``most`` is the largest difference between ``b`` and any linked
    partner, ``apart`` holds the shingles of one set only, those that ``a`` lacks first.
    """

    def measure(medoid: np.ndarray, member: np.ndarray) -> tuple:
        more = np.setdiff1d(member, medoid, assume_unique=True)
        less = np.setdiff1d(medoid, member, assume_unique=True)
        size = len(member)
        most = (size + size * 100 // percent) * (100 - percent) // (100 + percent)
        apart = np.concatenate((more, less)).view(np.int64)
        return size - len(more), size + len(less), size, most, apart

    names = dict.fromkeys(("common", "total", "size", "most"), pa.int64())
    return pairwise(pairs, texts, n, names | {"apart": pa.list_(pa.int64())}, measure)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in each of 64 * 2**i places, ``SKETCH_BITS`` at most.

    There are twice as many places as shingles or more; beyond that size the bound is only weaker.
    """
    places = 64
    while places < min(2 * len(shingles), SKETCH_BITS):
        places *= 2
    place = mix(shingles ^ np.uint64(0xD1342543DE82EF95)) & np.uint64(places - 1)
    odd = np.bincount(place.astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """(id, size, sketch) of the packed ``texts``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in unpacked(batch.column(1)):
                for part in text_slices(column):
                    sets = shingle_sets(part, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first + part.first, len(sets)),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([parity_sketch(s) for s in sets], pa.binary()),
                        ],
                        names=["id", "size", "sketch"],
                    )

    return texts.select("id", "packed").mapInArrow(sketch, "id bigint, size bigint, sketch binary")


def fewest_apart(
    size: np.ndarray, sketch: list[bytes], i: np.ndarray, j: np.ndarray
) -> np.ndarray:
    """A lower bound of the shingles in which the sets ``i`` and ``j`` of each pair differ.

    Of two sketches the longer one is folded to the length of the other.
    """
    words = np.array([len(s) // 8 for s in sketch], np.int64)
    least = np.minimum(words[i], words[j])
    out = np.abs(size[i] - size[j])
    for width in np.unique(least):
        at = np.flatnonzero(least == width)
        used, place = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        table = np.empty((len(used), width), np.uint64)
        for row, k in enumerate(used):
            bits = np.frombuffer(sketch[k], np.uint64).reshape(-1, width)
            table[row] = bits[0] if len(bits) == 1 else np.bitwise_xor.reduce(bits, axis=0)
        step = max(1, (1 << 20) // int(width))
        for begin in range(0, len(at), step):
            one, other = place[: len(at)][begin : begin + step], place[len(at) :][begin : begin + step]
            bits = np.bitwise_count(table[one] ^ table[other]).sum(axis=1, dtype=np.int64)
            some = at[begin : begin + step]
            out[some] = np.maximum(out[some], bits)
    return out


def may_link(apart: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``total`` shingles that differ in ``apart`` or more can be linked."""
    return apart * (100 + percent) <= total * (100 - percent)


def possible(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not exclude."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            size = np.concatenate([batch.column(c).to_numpy() for c in (2, 4)])
            both = [*batch.column(3).to_pylist(), *batch.column(5).to_pylist()]
            i = np.arange(rows)
            near = may_link(
                fewest_apart(size, both, i, i + rows), size[:rows] + size[rows:], percent
            )
            yield batch.select(["a", "b"]).filter(pa.array(near))

    with_a = pairs.select("a", "b").join(
        sketch.selectExpr("id AS a", "size AS size_a", "sketch AS sketch_a"), "a"
    )
    both = with_a.join(sketch.selectExpr("id AS b", "size AS size_b", "sketch AS sketch_b"), "b")
    both = both.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    return both.mapInArrow(judge, "a bigint, b bigint").distinct()


def linked(percent: int) -> str:
    return f"(100 * common >= {percent} * total)"


def jaccard_components(
    docs: DataFrame,
    n: int = 4,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, representative).

    ``component_id`` is the smallest id reachable by links, ``representative`` the smallest id of
    the documents with the very same set. Ids are whole numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets = settled(shingle_counts(docs, n, id_col, text_col), "ngram-sets")
    first = (
        sets.filter(f"n_shingles > 0 AND `{id_col}` IS NOT NULL")
        .groupBy("low", "high")
        .agg(F.min(id_col).cast("bigint").alias("representative"))
    )
    # Written, so that the join below deals both sides anew and Spark can split a hot digest.
    first = settled(first, "ngram-first")
    named = settled(
        sets.join(first, ["low", "high"], "left").select(id_col, "n_shingles", "representative"),
        "ngram-named",
    )

    # A document signs at most 0.4 times its shingles, and a few more if it is short.
    shingles = named.agg(F.expr("coalesce(sum(0.4 * n_shingles + 5), 0)")).first()[0]
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), int(shingles) // ROWS_PER_TASK + 1
    )
    copies = (
        named.filter(f"representative <> `{id_col}`")
        .selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", "representative AS rep")
        .distinct()
    )
    star = (
        signature_rows(docs, n, percent, id_col, text_col)
        .repartition(tasks, "sig")
        .mapInArrow(stars, "size bigint, first bigint, centre bigint, member bigint")
    )
    star = settled(
        star.join(copies.selectExpr("id AS centre", "rep AS rep_c"), "centre", "left")
        .join(copies.selectExpr("id AS member", "rep AS rep_m"), "member", "left")
        .selectExpr(
            "size",
            "first",
            "coalesce(rep_c, centre) AS centre",
            "coalesce(rep_m, member) AS member",
        )
        .filter("centre <> member"),
        "ngram-star",
    )

    pairs = star.selectExpr("centre AS a", "member AS b").distinct()
    wanted = star.selectExpr("centre AS id").union(star.selectExpr("member AS id")).distinct()
    texts = settled(
        packed(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), "text")
        .filter("id IS NOT NULL AND packed IS NOT NULL")
        .join(wanted, "id", "left_semi"),
        "ngram-texts",
    )
    # First one pair for each member, with the smallest centre in the order of a hash, which most
    # buckets of a family have in common; then only pairs that these links have not connected.
    chosen = pairs.groupBy("b").agg(F.expr("min_by(a, struct(xxhash64(a), a)) AS a"))
    chosen = settled(chosen.select("a", "b"), "ngram-chosen")
    sketch = settled(sketches(texts, n), "ngram-sketches")
    first_pairs = settled(possible(chosen, sketch, percent), "ngram-pairs")
    first_known = settled(confirmed(first_pairs, texts, n), "ngram-known")
    first_links = first_known.filter(linked(percent)).select("a", "b")
    open_pairs = apart_pairs(pairs, components(first_links, "ngram-first"))
    open_pairs = settled(open_pairs.join(chosen, ["a", "b"], "left_anti"), "ngram-open")
    near_pairs = settled(possible(open_pairs, sketch, percent), "ngram-pairs")
    more_known = settled(confirmed(near_pairs, texts, n), "ngram-known")
    known = first_known.union(more_known)
    links = known.filter(linked(percent)).select("a", "b")
    # Rows that repeat an id with another text tie their sets together.
    tied = named.filter("representative IS NOT NULL").selectExpr(
        f"CAST(`{id_col}` AS BIGINT) AS a", "representative AS b"
    ).filter("a <> b")
    placed, mixed = mixed_groups(star, components(links, "ngram-part"))
    unused = [sets, first, star, chosen, first_pairs, open_pairs, near_pairs, placed, mixed]
    seen = known.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    found = stray_pairs(placed, mixed.filter(f"strays <= {STRAYS}"), sketch, percent)
    found = settled(found.join(seen, ["a", "b"], "left_anti"), "ngram-strays")
    unused.append(found)
    if not found.isEmpty():
        nearest = found.groupBy("low_at", "high_at").agg(
            F.expr("min_by(struct(a, b), struct(apart, a, b)) AS pair")
        )
        nearest = settled(nearest.select("pair.a", "pair.b"), "ngram-nearest")
        some = settled(confirmed(nearest, texts, n), "ngram-more")
        links = links.union(some.filter(linked(percent)).select("a", "b"))
        rest = apart_pairs(found, components(links, "ngram-part"))
        rest = settled(rest.join(nearest, ["a", "b"], "left_anti"), "ngram-rest")
        more = settled(confirmed(rest, texts, n), "ngram-more")
        links = links.union(more.filter(linked(percent)).select("a", "b"))
        unused += [nearest, rest]
    large = settled(
        star.filter(f"size > {CENTRES + 1}")
        .join(mixed.filter(f"strays > {STRAYS}").select("first"), "first")
        .select("first", "centre", "member")
        .distinct(),
        "ngram-groups",
    )
    unused.append(large)
    if not large.isEmpty():
        main = placed.join(mixed.select("first", "at"), ["first", "at"]).drop("at")
        apart = settled(_apart(large, main, known, texts, n, percent), "ngram-apart")
        near = apart.filter(linked(percent)).selectExpr("medoid AS a", "member AS b")
        links = settled(links.union(near).filter("a <> b"), "ngram-links")
        rest = _rest(apart, components(links, "ngram-part"), percent)
        rest = settled(rest.join(seen, ["a", "b"], "left_anti"), "ngram-rest")
        rest_near = settled(possible(rest, sketch, percent), "ngram-pairs")
        more = settled(confirmed(rest_near, texts, n), "ngram-more")
        links = links.union(more.filter(linked(percent)).select("a", "b"))
        unused += [apart, rest, rest_near]
    graph = components(links.union(tied), "ngram-all")
    for table in (*unused, texts, sketch, first_known, more_known):
        drop_written(table)
    return (
        named.join(graph.withColumnRenamed("node", id_col), id_col, "left")
        .withColumn(
            "component_id", F.coalesce("component", F.col(id_col).cast("bigint"))
        )
        .select(id_col, "n_shingles", "component_id", "representative")
    )


def apart_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends lie in different components."""
    return (
        pairs.join(parts.selectExpr("node AS a", "component AS at_a"), "a", "left")
        .join(parts.selectExpr("node AS b", "component AS at_b"), "b", "left")
        .filter("coalesce(at_a, a) <> coalesce(at_b, b)")
        .select("a", "b")
    )


def mixed_groups(star: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of members with a common first centre that links have not connected so far.

    Returns (first, member, at) for the members of groups and their components, and (first, at, members,
    strays): the largest component of a group that is not connected, its members, and those elsewhere.
    Buckets of no more members than centres are compared already.
    """
    groups = star.filter(f"size > {CENTRES + 1}")
    both = groups.select("first", "member").union(groups.selectExpr("first", "centre AS member"))
    placed = (
        both.distinct()
        .join(parts.withColumnRenamed("node", "member"), "member", "left")
        .selectExpr("first", "member", "coalesce(component, member) AS at")
    )
    placed = settled(placed, "ngram-member")
    mixed = (
        placed.groupBy("first", "at")
        .agg(F.count("*").alias("n"))
        .groupBy("first")
        .agg(
            F.expr("max_by(at, struct(n, at)) AS at"),
            F.sum("n").alias("members"),
            F.expr("sum(n) - max(n) AS strays"),
        )
        .filter("strays > 0")
    )
    return placed, settled(mixed, "ngram-main")


def stray_pairs(
    placed: DataFrame, mixed: DataFrame, sketch: DataFrame, percent: int
) -> DataFrame:
    """(a, b, low_at, high_at, apart): pairs of a stray and a member elsewhere that sketches let stand.

    Members are dealt in pieces of about ``PIECE``, the strays of the group go to each.
    """
    columns = ["member", "at", "size", "sketch"]
    member = (
        placed.join(mixed.withColumnRenamed("at", "main_at"), "first")
        .join(sketch.withColumnRenamed("id", "member"), "member")
        .withColumn("last", F.expr(f"members div {PIECE}"))
    )
    pieces = "explode(sequence(0L, last)) AS piece"
    strays = member.filter("at <> main_at").selectExpr("first", pieces, "true AS stray", *columns)
    own = "pmod(xxhash64(member), last + 1) AS piece"
    dealt = strays.union(member.selectExpr("first", own, "false AS stray", *columns))

    def meet(rows: pa.Table) -> pa.Table:
        stray = rows["stray"].to_numpy()
        member, at, size = (rows[c].to_numpy() for c in ("member", "at", "size"))
        sketch = rows["sketch"].to_pylist()
        a, others = np.flatnonzero(stray), np.flatnonzero(~stray)
        pairs = []
        for some in np.array_split(a, len(a) * len(others) // (1 << 20) + 1):
            i, j = np.repeat(some, len(others)), np.tile(others, len(some))
            total = size[i] + size[j]
            keep = (at[i] != at[j]) & may_link(np.abs(size[i] - size[j]), total, percent)
            i, j, total = i[keep], j[keep], total[keep]
            apart = fewest_apart(size, sketch, i, j)
            keep = may_link(apart, total, percent)
            pairs.append((i[keep], j[keep], apart[keep]))
        i, j, apart = (np.concatenate(c) for c in zip(*pairs))
        return pa.table(
            {
                "a": np.minimum(member[i], member[j]),
                "b": np.maximum(member[i], member[j]),
                "low_at": np.minimum(at[i], at[j]),
                "high_at": np.maximum(at[i], at[j]),
                "apart": apart,
            }
        )

    schema = "a bigint, b bigint, low_at bigint, high_at bigint, apart bigint"
    found = dealt.groupBy("first", "piece").applyInArrow(meet, schema)
    return found.groupBy("a", "b", "low_at", "high_at").agg(F.min("apart").alias("apart"))


def _apart(
    groups: DataFrame, main: DataFrame, known: DataFrame, texts: DataFrame, n: int, percent: int
) -> DataFrame:
    """(first, medoid, member, ...): differences of all members that share a first centre."""
    compared = (
        groups.selectExpr("first", "member", "centre AS a", "member AS b")
        .join(known.selectExpr("a", "b", "1 - common / total AS far"), ["a", "b"])
        .groupBy("first", "member")
        .agg(F.avg("far").alias("far"))
    )
    medoid = (
        main.join(compared, ["first", "member"], "left")
        .groupBy("first")
        .agg(F.expr("min_by(member, struct(coalesce(far, 1), member)) AS medoid"))
    )
    member = groups.select("first", "member").union(groups.select("first", "centre")).distinct()
    member = member.join(medoid, "first").filter("member <> medoid")
    member = settled(member, "ngram-member")
    measured = differences(
        member.selectExpr("medoid AS a", "member AS b").distinct(), texts, n, percent
    ).withColumnsRenamed({"a": "medoid", "b": "member"})
    return member.join(measured, ["medoid", "member"])


def _rest(apart: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a stray and another member that may link; see step 4 above."""
    # Shingles in the heads of most members of a group; at most twice as many as a head has.
    sizes = apart.groupBy("first").agg(F.count("*").alias("n"))
    odd = (
        apart.selectExpr("first", "explode(slice(apart, 1, CAST(most + 1 AS INT))) AS shingle")
        .groupBy("first", "shingle")
        .agg(F.count("*").alias("times"))
        .join(sizes, "first")
        .filter("2 * times > n")
        .groupBy("first")
        .agg(F.sort_array(F.collect_list("shingle")).alias("odd"))
    )
    member = (
        apart.join(odd, "first", "left")
        .withColumn("odd", F.coalesce("odd", F.array().cast("array<bigint>")))
        .withColumn("apart", F.expr("concat(array_except(apart, odd), array_except(odd, apart))"))
        .join(parts.selectExpr("node AS medoid", "component AS centre_at"), "medoid", "left")
        .join(parts.selectExpr("node AS member", "component AS at"), "member", "left")
        .selectExpr(
            "first",
            "member",
            "coalesce(at, member) AS at",
            "coalesce(at, member) <> coalesce(centre_at, medoid) AS stray",
            "size",
            "most",
            "CAST(size(apart) AS BIGINT) AS far",
            "slice(apart, 1, CAST(most + 1 AS INT)) AS head",
        )
    )
    member = settled(member, "ngram-placed")

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        columns = {"member": name} | {c: f"{c}_{name}" for c in ("at", "size", "far", "most")}
        return df.selectExpr("first", *columns, *more).withColumnsRenamed(columns)

    stray = member.filter("stray")
    explode = "posexplode(head) AS (pos, shingle)"
    different = f"(size_a + size_b) * {100 - percent} div {100 + percent}"
    share = f"greatest(1, ceil((far_a + far_b - {different}) / 2))"
    sharing = (
        side(stray, "a", explode)
        .withColumnRenamed("pos", "pos_a")
        .join(side(member, "b", explode).withColumnRenamed("pos", "pos_b"), ["first", "shingle"])
        .filter(f"at_a <> at_b AND pos_a <= far_a - {share} AND pos_b <= far_b - {share}")
    )
    near = (
        side(stray.filter("far <= most"), "a")
        .join(side(member, "b"), "first")
        .filter(f"at_a <> at_b AND far_a + far_b <= {different}")
    )
    return (
        sharing.select("a", "b")
        .union(near.select("a", "b"))
        .selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
        .distinct()
    )
