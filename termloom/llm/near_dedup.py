"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, confirmation on full shingle sets.

A signature has K positions of b = 16 bits. It is cut into chunks of 4; two signatures that differ in at
most R positions must, by pigeonhole, have a chunk with at most one error. So each signature is indexed
under every chunk with every choice of one position left out, and all pairs within R meet in some bucket.

Texts of equal shingle sets are one class. In each bucket, members are first tried against a pivot, then in
rounds against another one where the last one resolved something; what is linked becomes components. Only where a
bucket still holds several components are the pairs between them compared, by signature, and those within
R confirmed. These pairs are dealt to tasks as pairs of blocks: the bucket's largest component meets the
others only. A large bucket is first indexed again by its members' other chunks, which keeps the
guarantee, where that leaves fewer pairs to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import cut, discard, map_arrow, materialise
from termloom.llm.components import components, merged

SHINGLE = 5
#: Positions, positions in a chunk, chunks.
K, CHUNK = 64, 4
CHUNKS = K // CHUNK
#: Signatures that differ in more positions aren't compared further. At a similarity of 0.75 a signature
#: differs in 16 +- 3.5 positions, so a pair there is missed about twice in 10,000; the guarantee holds for
#: R < 2 * (CHUNKS - 1), one level of indexing again included.
R = 28
#: Members up to which a bucket is dealt as it is; larger ones are indexed again where that saves work.
BUCKET = 512
#: Members of a block, at least. Blocks grow with the root of the bucket, so that a task's share stays small
#: beside the bucket and a member isn't sent to very many tasks.
BLOCK = 128
#: Shingles of a bucket's sets that are held in memory at once, twice; of longer texts, parts of a bucket meet in turn.
HELD = 2_000_000
#: A round tries a pivot in each bucket where the last one left at most this part of the members beside the largest component.
ROUND_LEAVES = 0.5
#: Most row ids that are broadcast to pick the texts to confirm.
IDS_BROADCAST = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(9))
_A = _RNG.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; a short text's words are one shingle."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    starts = split.offsets.to_numpy() - split.offsets[0].as_py()
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], np.uint64)
    at = flat.indices.to_numpy()
    real = np.array([bool(w) for w in words] or [False])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = at[a:b]
        h = hashes[own[real[own]]]
        n = len(h)
        if n >= SHINGLE:
            s = h[: n - SHINGLE + 1].copy()
            for i in range(1, SHINGLE):
                s = s * _STEP + h[i : n - SHINGLE + 1 + i]
        elif n:
            s = np.array([n], np.uint64)
            for i in range(n):
                s = s * _STEP + h[i]
        else:
            s = np.array([], np.uint64)
        s ^= s >> np.uint64(29)
        yield np.unique(s * np.uint64(0xBF58476D1CE4E5B9))


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of a shingle set, 16 bits each."""
    least = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[i : i + 2048, None] * _A + _B).min(0), out=least)
    return ((least ^ (least >> np.uint64(23)) ^ (least >> np.uint64(41))) & np.uint64(0xFFFF)).astype(np.uint16)


def _fixed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def signatures(rows: DataFrame) -> DataFrame:
    """From id and text: id, n_shingles, class (128-bit hash of the set; null if empty), signature (binary)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, classes, signed = [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signed.append(signature(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), _fixed(classes), _fixed(signed)], ["id", "n_shingles", "class", "signature"])

    return map_arrow(rows, f"id {dict(rows.dtypes)['id']}, n_shingles long, class binary, signature binary", run)


def chunk_keys(signed: np.ndarray) -> np.ndarray:
    """Keys of signatures (n x K): for every chunk and position left out, the other positions' bits."""
    wide = signed.astype(np.int64).reshape(-1, CHUNKS, CHUNK)
    out = np.empty((len(wide), CHUNKS, CHUNK), np.int64)
    for left_out in range(CHUNK):
        a, b, c = (wide[:, :, i] for i in range(CHUNK) if i != left_out)
        out[:, :, left_out] = (a << 32) | (b << 16) | c
    return (out | (np.arange(K, dtype=np.int64).reshape(CHUNKS, CHUNK) << 48)).reshape(-1, K)


def stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def index(reps: DataFrame) -> DataFrame:
    """A row for each signature and key: key, id."""
    kind = dict(reps.dtypes)["id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = chunk_keys(stacked(batch.column("signature")))
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), K)))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids], ["key", "id"])

    return map_arrow(reps.select("id", "signature"), f"key long, id {kind}", run)


def reindex(large: DataFrame) -> DataFrame:
    """Members (key, id, component, signature) of large buckets under a second key, from the chunks that the first one
    doesn't look at: key, second, id, component. Of a pair within R, at least two chunks have at most one error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = chunk_keys(stacked(batch.column("signature")))
        first = batch.column("key").to_numpy()
        keep = (np.arange(K) // CHUNK)[None, :] != (first >> 48)[:, None] // CHUNK
        row, at = np.nonzero(keep)
        key, id_, component = (batch.column(c).take(pa.array(row)) for c in ("key", "id", "component"))
        return pa.RecordBatch.from_arrays([key, pa.array(keys[row, at]), id_, component], ["key", "second", "id", "component"])

    kind = dict(large.dtypes)["id"]
    return map_arrow(large.select("key", "id", "component", "signature"), f"key long, second long, id {kind}, component {kind}", run)


def unresolved(members: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of members (keys, id, component) that hold several components: keys, n, main, others.

    ``main`` is the component with most members (the larger of equals), ``others`` the number of members beside it.
    """
    sizes = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.groupBy(*keys).agg(F.sum("size").alias("n"), F.max(F.struct("size", "component")).alias("most"))
    return groups.select(*keys, "n", F.col("most.component").alias("main"), (F.col("n") - F.col("most.size")).alias("others")).where("others > 0")


def grouped_again(large: DataFrame, reps: DataFrame, held: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Large buckets' members by second keys, and the buckets that are better dealt as they are.

    Both are unresolved members (key, second, id, component, n, main, others, signature, n_shingles). A bucket goes
    by second keys where the groups' pairs to compare come to less than its own. ``held`` writes a table that isn't
    needed for long.
    """
    again = held(reindex(large), "again")
    groups = held(unresolved(again, ["key", "second"]), "groups")
    work = groups.groupBy("key").agg(F.sum(F.col("n") * F.col("others")).alias("work"))
    whole = large.groupBy("key").agg(F.first(F.col("n") * F.col("others")).alias("own")).join(work, "key").where("work >= own").select("key")
    whole = held(whole, "whole")
    members = again.join(groups.join(whole, "key", "left_anti"), ["key", "second"]).join(reps, "id")
    return members, large.join(whole, "key", "left_semi")


def blocks_of(n: Column) -> Column:
    """Blocks that so many members are dealt to: of BLOCK members, and more as the members' root grows."""
    part = n.cast("double") / BLOCK
    return F.greatest(F.ceil(F.least(part, F.sqrt(part) * 4)), F.lit(1)).cast("long")


def dealt(members: DataFrame) -> DataFrame:
    """Unresolved members with their blocks and tiles: block, tile, across; a row for each tile that a member is in.

    A tile is a pair of blocks of ``others``, one of them with itself (not across), or one with a block of ``main``,
    whose members are linked already. Where there are few others, a member of main is in few tiles.
    """
    few, many = blocks_of(F.col("others")), blocks_of(F.col("n") - F.col("others"))
    rows = members.withColumn("few", few).withColumn("many", many).withColumn("inside", F.col("component") == F.col("main"))
    at = F.pmod(F.xxhash64(F.lit(17), "id"), F.when(F.col("inside"), F.col("many")).otherwise(F.col("few")))
    rows = rows.withColumn("at", at).withColumn("block", F.when(F.col("inside"), F.col("few") + F.col("at")).otherwise(F.col("at")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tile = lambda number, across: F.struct(number.cast("long").alias("tile"), across.alias("across"))
    square = F.col("few") * F.col("few")
    main_tiles = F.transform(upto("few"), lambda i: tile(square + i * F.col("many") + F.col("at"), F.lit(True)))
    other_tiles = F.concat(
        F.transform(upto("few"), lambda j: tile(F.least("at", j) * F.col("few") + F.greatest("at", j), F.col("at") != j)),
        F.transform(upto("many"), lambda k: tile(square + F.col("at") * F.col("many") + k, F.lit(True))),
    )
    rows = rows.withColumn("t", F.explode(F.when(F.col("inside"), main_tiles).otherwise(other_tiles)))
    return rows.select("key", "second", "id", "component", "signature", "n_shingles", "block", "t.tile", "t.across")


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1) <= R


def tile_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's members of different components within R, as row numbers.

    Of two blocks, only pairs across. A pair belongs to the first key that both share and, where its bucket was
    indexed again, to the first second key that both share; elsewhere it is passed over. Compared in steps of rows.
    """
    signed = stacked(rows.column("signature").combine_chunks())
    keys = chunk_keys(signed)
    _, component = np.unique(np.array(rows.column("component").to_pylist()), return_inverse=True)
    block = rows.column("block").to_numpy()
    across = rows.column("across")[0].as_py()
    first, second = rows.column("key")[0].as_py() >> 48, rows.column("second")[0].as_py()
    elsewhere = np.arange(K) // CHUNK != first // CHUNK
    left, right = [np.array([], np.int64)], [np.array([], np.int64)]
    step = max(1, (4 << 20) // max(1, len(signed) * K))
    for i in range(0, len(signed), step):
        near = within(signed[i : i + step, None, :], signed[None, i:, :]) & (component[i : i + step, None] != component[None, i:])
        if across:
            near &= block[i : i + step, None] != block[None, i:]
        a, b = np.nonzero(np.triu(near, 1))
        shared = keys[a + i] == keys[b + i]
        own = shared.argmax(1) == first
        if second >= 0:
            own &= (shared & elsewhere).argmax(1) == second >> 48
        left.append(a[own] + i), right.append(b[own] + i)
    return np.concatenate(left), np.concatenate(right)


def grouped(rows: DataFrame, keys: list[str], schema: str, flush) -> DataFrame:
    """Apply ``flush`` to the rows of each key, which a task reads one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for whole in batches:
            for batch in cut(whole):
                values = np.stack([batch.column(k).to_numpy() for k in keys])
                edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if held and tuple(values[:, i]) != last:
                        if (out := flush(pa.Table.from_batches(held))) is not None:
                            yield out
                        held = []
                    held.append(batch.slice(i, j - i))
                    last = tuple(values[:, i])
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


TILE = ["key", "second", "tile"]
MEETING = [*TILE, "part"]


def meetings(members: DataFrame) -> DataFrame:
    """Which members have to meet: key, second, tile, part, at, id, component, partners.

    A row per member (of ``dealt``) of a tile that has a pair within R across components; ``partners`` are places
    (``at``) within the part. Of long texts, a tile falls into parts of HELD shingles a side.
    """
    kind = dict(members.dtypes)["id"]

    def flush(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        left, right = tile_pairs(rows)
        if not len(left):
            return None
        used = np.unique(np.concatenate([left, right]))
        piece = np.zeros(rows.num_rows, np.int64)
        piece[used] = np.cumsum(rows.column("n_shingles").to_numpy()[used]) // HELD
        parts = piece[left] << 20 | piece[right]
        out: list[tuple[int, int, int, list[int]]] = []
        for part in np.unique(parts).tolist():
            a, b = left[parts == part], right[parts == part]
            inside = np.unique(np.concatenate([a, b]))
            at = {r: i for i, r in enumerate(inside.tolist())}
            partners: list[list[int]] = [[] for _ in at]
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                partners[at[x]].append(at[y])
            out += [(part, i, r, partners[i]) for r, i in at.items()]
        part, at, row, partners = zip(*out, strict=True)
        taken = rows.select(["id", "component"]).take(pa.array(row)).combine_chunks()
        same = [pa.array([rows.column(c)[0].as_py()] * len(out), pa.int64()) for c in TILE]
        columns = [*same, pa.array(part, pa.int64()), pa.array(at, pa.int64()), taken["id"].combine_chunks(), taken["component"].combine_chunks(), pa.array(partners, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, [*MEETING, "at", "id", "component", "partners"])

    return grouped(members, TILE, f"key long, second long, tile long, part long, at long, id {kind}, component {kind}, partners array<int>", flush)


def confirm_meetings(meeting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of each meeting, one for each two components that are found to be one."""
    kind = dict(meeting.dtypes)["id"]

    def flush(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.sort_by("at")
        sets_ = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        ids, component = rows.column("id").to_pylist(), rows.column("component").to_pylist()
        parent = {c: c for c in component}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        sizes = np.array([len(x) for x in sets_])
        _, local = np.unique(np.concatenate(sets_), return_inverse=True)
        ends = np.cumsum(sizes)
        words = [local[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        mark = np.zeros(int(local.max()) + 1 if len(local) else 0, bool)
        found = []
        for i, partners in enumerate(rows.column("partners").to_pylist()):
            if partners:
                mark[words[i]] = True
                for j in partners:
                    if root(component[i]) != root(component[j]):
                        both = np.count_nonzero(mark[words[j]])
                        if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                            parent[root(component[i])] = root(component[j])
                            found.append((ids[i], ids[j]))
                mark[words[i]] = False
        if not found:
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, rows.schema.field("id").type), pa.array(b, rows.schema.field("id").type)], ["a", "b"])

    return grouped(meeting.join(sets, "id"), MEETING, f"a {kind}, b {kind}", flush)


def pivots(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members with a member of their bucket that is of another component; another pivot each turn."""
    pivot = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("u"), "id", "component")).alias("p")
    pairs = members.join(members.groupBy("key").agg(pivot), "key").where("component != p.component")
    return pairs.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct()


def near_by_signature(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b), those within R."""
    side = [reps.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = within(stacked(batch.column("signature_a")), stacked(batch.column("signature_b")))
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return map_arrow(pairs.join(side[0], "a").join(side[1], "b"), pairs.schema, run)


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The shingle sets (binary) of the rows whose ids are in ``ids``."""
    number = ids.count()
    picked = rows.join(F.broadcast(ids) if number <= IDS_BROADCAST else ids, "id", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), _fixed([s.tobytes() for s in shingle_sets(batch.column("text"))])], ["id", "shingles"])

    return map_arrow(picked, f"id {dict(rows.dtypes)['id']}, shingles binary", run)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough: 100 * intersection >= percent * union."""
    side = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"shingles_{x}")) for x in "ab"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(side[0], "a").join(side[1], "b"), pairs.schema, run)


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words stand between ASCII white space, A-Z lower-cased; sets hold distinct five-word shingles, or the
    whole sequence of a shorter text. component_id is the smallest id reachable over links; the row with
    that id is kept. Null texts and texts without words are linked with nothing. Rows of equal sets are
    always one component, repeated rows too. A null id is never linked. Other columns are neither read nor
    returned; an empty table gives an empty result. Links are confirmed on full sets of 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialise(signatures(rows), "signatures")
    classes = materialise(signed.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "signature", "n_shingles").dropDuplicates(["id"])
    reps = materialise(reps, "reps")

    done_with = [reps]

    def held(df: DataFrame, name: str) -> DataFrame:
        done_with.append(materialise(df, name))
        return done_with[-1]

    keys = index(reps)
    buckets = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot != other")
    members = held(keys.join(buckets.select("key", "pivot"), "key"), "members")
    stars = members.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = held(near_by_signature(stars, reps), "stars")
    involved = held(members.select("id").distinct(), "involved")
    sets = held(sets_of(rows, involved).dropDuplicates(["id"]), "sets")
    found = components(held(confirm(stars, sets, percent), "confirmed"))
    done_with.append(found)

    def labelled(rows: DataFrame) -> DataFrame:
        own = rows.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "was", F.coalesce("component", "id").alias("component"))
        own = held(own, "labelled")
        return held(own.join(unresolved(own, ["key"]), "key"), "open")

    # ``was``: the bucket's others before the last round
    left, turn = labelled(members.withColumn("was", F.lit(2**62))), 0
    while not (tried := left.where(F.col("others") <= ROUND_LEAVES * F.col("was"))).isEmpty():
        links = held(confirm(near_by_signature(held(pivots(tried, turn), "pivots"), reps), sets, percent), "confirmed")
        done_with.append(found := merged(found, links))
        left, turn = labelled(left.select("key", "id", F.col("others").alias("was"))), turn + 1
    left = held(left.drop("was").join(reps, "id").withColumn("second", F.lit(-1).cast("long")), "unresolved")
    open_members = left.where(F.col("n") <= BUCKET)
    if not (large := left.where(F.col("n") > BUCKET)).isEmpty():
        for part in grouped_again(large, reps, held):
            open_members = open_members.unionByName(part)
    meeting = meetings(dealt(open_members))
    more = held(confirm_meetings(held(meeting, "meetings"), sets, percent), "confirmed")
    found = merged(found, more)
    discard(*(x for x in done_with if x is not found))

    label = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("class").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    done = signed.join(label, (F.col("class") == F.col("of")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
