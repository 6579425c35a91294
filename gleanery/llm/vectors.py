"""The k most similar vectors of every vector: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every usable vector is indexed. A vector
belongs to the list of its nearest centroid and asks in every list whose centroid is almost as near
(``margin`` in cosine, more for a vector that is far from all of them), however many those are. Lists are packed into
slots, near centroids together, so a vector is shipped once to its own slot and once to each further slot in which it
asks. Within a slot, asymmetric distances (the query against decoded members) rank the members of the asked lists
by their codes: in the nearest list the best are ranked again by their true vectors, then in all lists those whose
estimate comes within the error of the codes of the last of what is found so far, which rises as the lists go by. A list
larger than a slot is cut into blocks, each asked by all; a slot with very many askers is repeated, and each asker goes to
one of the copies.

Equal vectors are one question, and at most ``k`` + 1 of their ids can be an answer; they are folded before they are
shipped, again in each slot, and meet their ids at the end. Vectors are shipped as unit vectors of 16-bit numbers;
the similarities they give are off by about one millionth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.llm.arrow import map_batches, schema_of
from gleanery.session import cut, map_arrow

#: Least vectors in the fitted sample and those for each list, members of a slot, askers of one copy of a slot.
SAMPLE, EACH, SLOT, ASKERS = 16_384, 4, 131_072, 1_048_576
#: Members of a list up to ``GROW`` lists; from there lists grow with the square root of the rows, up to ``LISTS``.
MEMBERS, GROW, LISTS = 300, 4_096, 65_536
#: Similarities held at once, and askers that are compared at once.
CELLS, TOGETHER = 1 << 22, 512
#: Askers or copies of one vector in a block when answers meet their ids.
BLOCK = 4_096
#: Slots into which smaller tables are packed, for parallelism, and the least members of one.
SLOTS, LEAST = 16, 512
#: Parts of a vector and codes of a part.
PARTS, CODES = 32, 256


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` that are usable (exactly ``dim`` finite numbers, not all zero) and their unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    good = (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    at = np.flatnonzero(good)
    x = values[offsets[:-1][at][:, None] + np.arange(dim)] if len(at) else np.empty((0, dim))
    usable = np.isfinite(x).all(1) & (x != 0).any(1)
    x, at = x[usable], at[usable]
    x = x / np.abs(x).max(1, keepdims=True, initial=0) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return at, x.astype(np.float32)


def lists_for(rows: int) -> int:
    few = max(1, rows // MEMBERS)
    return few if few <= GROW else int(min(LISTS, GROW * (few / GROW) ** 0.5))


def _nearest(x: np.ndarray, c: np.ndarray, less: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """The row of ``c`` with the greatest product of each row of ``x``, and that product; a bounded number of products at once."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    step = max(1, CELLS // len(c))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ c.T - less
        near = s.argmax(1)
        at[a : a + step] = near
        best[a : a + step] = s[np.arange(len(near)), near]
    return at, best


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), k, False))].astype(np.float32)
    for _ in range(rounds):
        near, _ = _nearest(x, c, 0 if spherical else 0.5 * (c * c).sum(1))
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        starts = np.concatenate([[0], np.cumsum(count)])[full]
        c[full] = np.add.reduceat(x[order], starts) / count[full][:, None]
        if spherical:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(norm > 0, c / np.maximum(norm, 1e-12), x[rng.choice(len(x), k)]).astype(np.float32)
    return c


class Index:
    """Coarse centroids, codebooks and the plan of slots; its size is bounded by the parameters, not by the data."""

    def __init__(self, sample: np.ndarray, rows: int, margin: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        lists = int(min(len(sample), lists_for(rows)))
        self.margin = margin
        self.centroids = _kmeans(sample, lists, 8, rng, True)
        near, close = _nearest(sample, self.centroids, 0)
        self.usual = float(np.median(close))
        rest = sample - self.centroids[near]
        self.parts = next(p for p in range(min(PARTS, sample.shape[1]), 0, -1) if sample.shape[1] % p == 0)
        self.width = sample.shape[1] // self.parts
        self.books = np.stack([_kmeans(np.ascontiguousarray(rest[:, p * self.width : (p + 1) * self.width]), min(CODES, len(rest)), 6, rng, False) for p in range(self.parts)])
        self.fit_error(sample, rng)

    def fit_error(self, sample: np.ndarray, rng: np.random.Generator) -> None:
        """How far a true similarity lies above its estimate, for close pairs of the sample, in all but a thousandth."""
        own, _ = _nearest(sample, self.centroids, 0)
        decoded = self.decode(self.encode(sample, own), own)
        q = sample[rng.choice(len(sample), min(len(sample), 1024), False)]
        true = q @ sample.T
        close = np.argpartition(-true, min(16, len(sample) - 1), axis=1)[:, :17]
        off = np.take_along_axis(true, close, 1) - np.take_along_axis(q @ decoded.T, close, 1)
        self.slack = float(max(0.01, np.quantile(off, 0.999)))

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list of each row, the similarity from which on it asks, and the rows and lists that belong together."""
        own, least, rows, lists = np.empty(len(x), np.int64), np.empty(len(x), np.float32), [], []
        step = max(1, CELLS // len(self.centroids))
        for a in range(0, len(x), step):
            s = x[a : a + step] @ self.centroids.T
            best = s.max(1)
            # a vector far from every centroid has its neighbours far off and scattered: it asks more widely
            wider = np.maximum(1, (1 - best) / max(1e-6, 1 - self.usual))
            own[a : a + step] = s.argmax(1)
            least[a : a + step] = best - self.margin * wider
            r, l = np.nonzero(s >= least[a : a + step, None])
            rows.append(r + a)
            lists.append(l)
        none = np.empty(0, np.int64)
        return own, least, np.concatenate([none, *rows]), np.concatenate([none, *lists])

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[own]
        codes = np.empty((len(x), self.parts), np.uint8)
        for p, book in enumerate(self.books):
            codes[:, p], _ = _nearest(rest[:, p * self.width : (p + 1) * self.width], book, 0.5 * (book * book).sum(1))
        return codes

    def plan(self, members: np.ndarray, askers: np.ndarray, slot: int | None = None, most_askers: int = ASKERS) -> None:
        """Packs lists into slots: near centroids together, no slot of over twice the aim where a list is no larger."""
        rng = np.random.default_rng(1)
        aim = slot or int(min(SLOT, max(LEAST, members.sum() // SLOTS)))
        groups = int(min(len(members), max(1, -(-members.sum() // aim))))
        near, _ = _nearest(self.centroids, _kmeans(self.centroids, groups, 10, rng, True), 0)
        by = np.argsort(near, kind="stable")
        packs, work = [], np.split(by, np.searchsorted(near[by], np.arange(1, groups)))
        while work:
            part = work.pop()
            if len(part) > 1 and members[part].sum() > 2 * aim:
                c = self.centroids[part]
                side = (c @ _kmeans(c, 2, 8, rng, True).T).argmax(1)
                if side.all() or not side.any():
                    side = np.arange(len(part)) % 2
                work += [part[side == 0], part[side == 1]]
            elif len(part):
                packs.append(part)
        self.base = np.zeros(len(members), np.int64)  # first slot of a list
        self.blocks = np.ones(len(members), np.int64)  # slots over which a list is spread
        copies, slots = [], 0
        for part in packs:
            blocks = int(max(1, -(-members[part].sum() // (2 * aim)))) if len(part) == 1 else 1
            self.base[part], self.blocks[part] = slots, blocks
            copies += [int(max(1, -(-askers[part].max() // most_askers)))] * blocks
            slots += blocks
        self.copies = np.array(copies)
        self.first = np.concatenate([[0], np.cumsum(self.copies)])
        self.partitions = int(self.first[-1])

    def decode(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What the codes say of each member: its centroid and the entry of each part."""
        out = self.centroids[own]
        for p, book in enumerate(self.books):
            out[:, p * self.width : (p + 1) * self.width] += book[codes[:, p]]
        return out

    def estimate(self, codes: np.ndarray, l: int, q: np.ndarray) -> np.ndarray:
        """Estimated similarities, members x queries. The coarse part and the sum over the tables of the parts (query parts against
        codebook parts) come from one product with the decoded members, which is several times as fast as looking up each part."""
        return self.decode(codes, np.full(len(codes), l)) @ q.T


_WORD = np.random.default_rng(11).integers(1, 1 << 63, (2, 4096), np.uint64) | np.uint64(1)


def pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit numbers."""
    return np.rint(x * 32767).astype("<i2")


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(packed: np.ndarray) -> np.ndarray:
    """128-bit hashes of packed vectors, as two signed numbers each."""
    dim = packed.shape[1]
    words = np.zeros((len(packed), -(-dim // 4) * 4), "<i2")
    words[:, :dim] = packed
    words = words.view("<u8")
    out = np.empty((len(packed), 2), np.uint64)
    for k in (0, 1):
        h = np.zeros(len(packed), np.uint64)
        for w in range(words.shape[1]):
            h = (h ^ words[:, w]) * _WORD[k, w % 4096]
            h ^= h >> np.uint64(29)
        out[:, k] = h
    return out.view(np.int64)


def folded(h: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows to keep of each key: those of its ``most`` least ids, once each, ordered by key and id; and which are the first of a key."""
    order = np.lexsort((ids, h[:, 1], h[:, 0]))
    g, i = h[order], ids[order]
    change = np.ones(len(g), bool)
    change[1:] = (g[1:] != g[:-1]).any(1)
    fresh = change.copy()
    fresh[1:] |= i[1:] != i[:-1]
    order, change = order[fresh], change[fresh]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    keep = nth < most
    return order[keep], change[keep]


def _top(score: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of two dimensions, faster."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Slot:
    """The members of a slot in the order of their lists; of equal vectors those with the ``most`` least ids."""

    def __init__(self, index: Index, x: np.ndarray, ids: np.ndarray, most: int, h: np.ndarray | None = None) -> None:
        kept, _ = folded(keys(pack(x)) if h is None else h, ids, most)
        x, ids = x[kept], ids[kept]
        own, _ = _nearest(x, index.centroids, 0)
        order = np.lexsort((ids, own))
        self.x, self.ids, self.own = x[order], ids[order], own[order]
        self.decoded = index.decode(index.encode(self.x, self.own), self.own)
        self.lists, self.starts = np.unique(self.own, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.own))


class Best:
    """The best ``k`` ids of each query so far, each id by its best row; ties go to the lesser id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.sims = np.full((n, k), -np.inf, np.float32)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def floor(self) -> np.ndarray:
        return self.sims[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        good = (sims > self.floor[rows]) | ((sims == self.floor[rows]) & (ids < self.ids[rows, -1]))
        rows, ids, sims = rows[good], ids[good], sims[good]
        if not len(rows):
            return
        own = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(own, self.k)])
        ids, sims = np.concatenate([ids, self.ids[own].ravel()]), np.concatenate([sims, self.sims[own].ravel()])
        order = np.lexsort((-sims, ids, rows))  # the best row of each id first
        rows, ids, sims = rows[order], ids[order], sims[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | ~np.isfinite(sims[1:])
        rows, ids, sims = rows[once], ids[once], sims[once]
        order = np.lexsort((ids, -sims, rows))
        rows, ids, sims = rows[order], ids[order], sims[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        top = nth < self.k
        # places that an id held twice leaves open
        self.sims[own], self.ids[own] = -np.inf, np.iinfo(np.int64).max
        self.sims[rows[top], nth[top]], self.ids[rows[top], nth[top]] = sims[top], ids[top]


def answer(index: Index, slot: Slot, q: np.ndarray, least: np.ndarray, k: int, rerank: int) -> Best:
    """The up to ``k`` nearest ids of each query, its own among them. A query asks in the lists whose centroid is at ``least`` as
    near. What is held grows with the queries and ``k``, not with how many members are as near."""
    out = Best(len(q), k)
    coarse = q @ index.centroids[slot.lists].T
    asked = coarse >= least[:, None] - 1e-6
    # queries of one list together, so that they ask in the same lists
    order = np.lexsort((-coarse.max(1), coarse.argmax(1)))
    for a in range(0, len(q), TOGETHER):
        rows = order[a : a + TOGETHER]
        # in the order of nearness of the lists to these queries, so that the bar is high early
        for i in np.argsort(-np.where(asked[rows], coarse[rows], -1).sum(0), kind="stable").tolist():
            some = rows[asked[rows, i]]
            if len(some):
                _ask(index, slot, out, i, q, some, rerank)
    return out


def _ask(index: Index, slot: Slot, out: Best, i: int, q: np.ndarray, rows: np.ndarray, rerank: int) -> None:
    a, b = int(slot.starts[i]), int(slot.ends[i])
    for c in range(a, b, 4096):
        d = min(b, c + 4096)
        score = q[rows] @ slot.decoded[c:d].T
        row, m = _where(score >= out.floor[rows][:, None] - index.slack)
        if len(m) > rerank * len(rows) // 4 and d - c > rerank:
            # many: the best by code first, as they raise the bar for all others
            t = _top(score, rerank)
            true = np.einsum("qrd,qd->qr", slot.x[t + c], q[rows])
            bar = np.maximum(out.floor[rows], np.partition(true, rerank - out.k, axis=1)[:, rerank - out.k])
            near = true >= bar[:, None]
            out.add(np.repeat(rows, rerank)[near.ravel()], slot.ids[t[near] + c], true[near])
            row, m = _where(score >= out.floor[rows][:, None] - index.slack)
        if len(m) * 16 > score.size:  # many: a matrix product leaves few to compare singly
            close = (q[rows] @ slot.x[c:d].T)[row, m] >= out.floor[rows[row]] - 1e-5
            row, m = row[close], m[close]
        for e in range(0, len(m), 200_000):
            r, t = rows[row[e : e + 200_000]], m[e : e + 200_000] + c
            out.add(r, slot.ids[t], np.einsum("nd,nd->n", slot.x[t], q[r]))


def similar_vectors(df: DataFrame, k: int = 5, dim: int = 96, margin: float = 0.08, rerank: int = 48, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every usable vector the ``k`` others of greatest cosine: ``id``, ``neighbour``, ``rank`` from 1, ``similarity``.

    Usable: a non-null integer id and exactly ``dim`` finite numbers, not all zero; other rows take no part. Rows of
    one id never answer each other, and an id answers once, by its best row. Ties go to the lesser id. With fewer than
    ``k`` others all come out; an empty table gives no rows. Only the id and the vector are read.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    schema = "id long, neighbour long, rank int, similarity double"
    rows = df.select(id_col).count()
    if not rows:
        return spark.createDataFrame([], schema)
    # about so many rows by the hash of their id; the limit bounds the draw where ids repeat
    size = max(SAMPLE, EACH * lists_for(rows))
    share = min(1.0, size / rows)
    drawn = src.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(np.ceil(share * 1_000_000_000))).limit(2 * size).toArrow()
    _, sample = unit_vectors(drawn.column("v"), dim)
    if not len(sample):
        _, sample = unit_vectors(src.limit(2 * size).toArrow().column("v"), dim)
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    index = Index(sample, rows, margin)
    lists = len(index.centroids)

    def count():
        def step(batch):
            _, x = unit_vectors(batch.column(1), dim)
            own, _, _, asked = index.near(x)
            m, a = np.bincount(own, minlength=lists), np.bincount(asked, minlength=lists)
            some = np.flatnonzero(a)
            return [pa.array(some), pa.array(m[some]), pa.array(a[some])]

        return step

    sizes = map_batches(src, "list int, members long, askers long", count).groupBy("list").agg(F.sum("members").alias("members"), F.sum("askers").alias("askers")).toArrow()  # at most LISTS rows
    members, askers = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    at = sizes.column("list").to_numpy()
    members[at], askers[at] = sizes.column("members").to_numpy(), sizes.column("askers").to_numpy()
    index.plan(members, askers)

    def ship():
        def step(batch):
            at, x = unit_vectors(batch.column(1), dim)
            ids, packed = batch.column(0).to_numpy()[at], pack(x)
            h = keys(packed)
            kept, leading = folded(h, ids, k + 1)
            x, ids, packed, h = x[kept], ids[kept], packed[kept], h[kept]
            own, least, row, asked = index.near(x)
            spread_by = h.view(np.uint64)[:, 1]
            # where each asks: all blocks of its lists, each slot once
            times = index.blocks[asked]
            row, slot = np.repeat(row, times), np.repeat(index.base[asked], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            home = index.base[own] + (spread_by % index.blocks[own].astype(np.uint64)).astype(np.int64)
            pair = np.unique(np.concatenate([row, np.arange(len(x))]) * np.int64(len(index.copies)) + np.concatenate([slot, home]))
            row, slot = pair // len(index.copies), pair % len(index.copies)
            member = slot == home[row]
            # of equal vectors one asks; the others are shipped as members alone
            here = member | leading[row]
            row, slot, member = row[here], slot[here], member[here]
            copies = index.copies[slot]
            mine = ((spread_by[row] >> np.uint64(40)) % copies.astype(np.uint64)).astype(np.int64)
            # a member goes to every copy of its slot, an asker to one of them
            times = np.where(member, copies, 1)
            row, slot, member, mine = (np.repeat(v, times) for v in (row, slot, member, mine))
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            copy = np.where(member, nth, mine)
            vectors = pa.Array.from_buffers(pa.binary(2 * dim), len(row), [None, pa.py_buffer(packed[row].tobytes())]).cast(pa.binary())
            return [pa.array(index.first[slot] + copy, pa.int32()), pa.array(member), pa.array((copy == mine) & leading[row]), pa.array(h[row, 0]), pa.array(h[row, 1]), pa.array(ids[row]), pa.array(least[row]), vectors]

        return step

    shipped = map_batches(src, "slot int, member boolean, asking boolean, h1 long, h2 long, id long, least float, v binary", ship)
    placed = shipped.repartitionById(index.partitions, F.col("slot")) if hasattr(shipped, "repartitionById") else shipped.repartition(index.partitions, "slot")
    placed = placed.sortWithinPartitions("slot", F.col("member").desc(), "h1", "h2", "id")
    near_type = "array<struct<far:float,neighbour:bigint>>"
    arrow_schema = to_arrow_schema(schema_of(f"h1 long, h2 long, near {near_type}"))

    def search(batches):
        out = arrow_schema

        def ask(slot, q, h, least):
            for c in range(0, len(q), 8192):
                best = answer(index, slot, q[c : c + 8192], least[c : c + 8192], k + 1, rerank)
                found = np.isfinite(best.sims)
                offsets = np.concatenate([[0], np.cumsum(found.sum(1))])
                pairs = pa.StructArray.from_arrays([pa.array(-best.sims[found], pa.float32()), pa.array(best.ids[found], pa.int64())], ["far", "neighbour"])
                yield pa.RecordBatch.from_arrays([pa.array(h[c : c + 8192, 0].copy()), pa.array(h[c : c + 8192, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(out.field(2).type)], schema=out)

        current, held, waiting, slot, last = None, [], [], None, None

        def close():
            """All members of a slot are here: those among them that ask are answered."""
            nonlocal slot
            if held and slot is None:
                x, ids, h = (np.concatenate(v) for v in zip(*held))
                held.clear()
                slot = Slot(index, x, ids, k + 1, h)
                for w in waiting:
                    yield from ask(slot, *w)
                waiting.clear()

        for batch in batches:
            slots = batch.column(0).to_numpy()
            is_member, asking = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            h = np.column_stack([batch.column(c).to_numpy() for c in (3, 4)])
            ids, least, x = batch.column(5).to_numpy(), batch.column(6).to_numpy(), unpack(batch.column(7), dim)
            for s in dict.fromkeys(slots.tolist()):
                if s != current:
                    yield from close()
                    current, slot, last = s, None, None
                for of_members in (True, False):
                    part = np.flatnonzero((slots == s) & (is_member == of_members))
                    if not len(part):
                        continue
                    if of_members:
                        held.append((x[part], ids[part], h[part]))
                    else:
                        yield from close()
                    # equal askers stand together: one is enough
                    part = part[asking[part]]
                    new = np.ones(len(part), bool)
                    new[1:] = (h[part][1:] != h[part][:-1]).any(1)
                    if len(part) and last == (of_members, *h[part[0]].tolist()):
                        new[0] = False
                    if len(part):
                        last = (of_members, *h[part[-1]].tolist())
                    part = part[new]
                    if of_members and len(part):
                        waiting.append((x[part], h[part], least[part]))
                    elif slot is not None and len(part):
                        yield from ask(slot, x[part], h[part], least[part])
        yield from close()

    found = map_arrow(placed, search, f"h1 long, h2 long, near {near_type}").where(F.size("near") > 0)
    # a slot gives at most k + 1 for a vector, and few slots are asked, so its list is short; an id in several answers once
    merged = found.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    once = F.filter("near", lambda x, i: F.array_position(F.col("near.neighbour"), x["neighbour"]) == i + 1)
    answers = merged.select("h1", "h2", F.slice(once, 1, k + 1).alias("near"))
    return _for_ids(src, answers, k, dim)


def _for_ids(src: DataFrame, answers: DataFrame, k: int, dim: int) -> DataFrame:
    """Answers of vectors as answers of ids, without the id itself. Vectors of very many ids meet them in blocks."""

    def named():
        def step(batch):
            at, x = unit_vectors(batch.column(1), dim)
            h = keys(pack(x))
            return [batch.column(0).take(pa.array(at)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]

        return step

    rows = cut(map_batches(src, "id long, h1 long, h2 long", named))
    of_id = rows.groupBy("id").agg(F.min("h1").alias("h1"), F.max("h1").alias("g1"), F.min("h2").alias("h2"), F.max("h2").alias("g2"))
    single = F.expr("h1 = g1 AND h2 = g2")
    one = of_id.where(single).select("id", "h1", "h2")
    several = rows.join(of_id.where(~single).select("id"), "id", "left_semi").distinct()

    def met(ids: DataFrame) -> DataFrame:
        hot = ids.groupBy("h1", "h2").count().where(F.col("count") > BLOCK).select("h1", "h2", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        salted = ids.join(hot, ["h1", "h2"], "left").select("id", "h1", "h2", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), "blocks")).cast("int").alias("block"))
        spread_ = answers.join(hot, ["h1", "h2"], "left").select("h1", "h2", "near", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        return salted.join(spread_, ["h1", "h2", "block"]).select("id", F.filter("near", lambda x: x["neighbour"] != F.col("id")).alias("near"))

    first = met(one).select("id", F.posexplode(F.slice("near", 1, k)).alias("at", "n")).select("id", F.col("n.neighbour").alias("neighbour"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("n.far")).cast("double").alias("similarity"))
    # an id with several vectors: the best of all of them
    best = met(several).select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.neighbour").alias("neighbour")).agg(F.max(-F.col("n.far")).cast("double").alias("similarity"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")).cast("int")).where(F.col("rank") <= k)
    return first.union(ranked.select("id", "neighbour", "rank", "similarity"))


def brute_force(df: DataFrame, queries: DataFrame, k: int = 5, dim: int = 96, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8_192) -> DataFrame:
    """The exact answer for the usable vectors of ``queries``, against all of ``df``, in blocks of queries."""
    spark = df.sparkSession
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")]
    src = df.select(*pick).where("id IS NOT NULL AND v IS NOT NULL")
    asked = cut(queries.select(*pick).where("id IS NOT NULL AND v IS NOT NULL"))
    blocks = max(1, -(-asked.count() // block))
    schema = "id long, neighbour long, similarity double"
    parts = []
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about ``block`` vectors
        at, q = unit_vectors(some.column("v"), dim)
        q_ids = some.column("id").to_numpy()[at]

        def setup(q=q, q_ids=q_ids):
            def step(batch):
                at, x = unit_vectors(batch.column(1), dim)
                ids = batch.column(0).to_numpy()[at]
                if not len(x) or not len(q):
                    return [[], [], []]
                s = q @ x.T
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                t = _top(s, k)
                v = np.take_along_axis(s, t, 1)
                ok = np.isfinite(v)
                return [pa.array(np.repeat(q_ids, t.shape[1])[ok.ravel()]), pa.array(ids[t][ok]), pa.array(v[ok].astype(float))]

            return step

        parts.append(map_batches(src, schema, setup))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    ranked = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbour"))), 1, k).alias("near"))
    return ranked.select("id", F.posexplode("near").alias("at", "n")).select("id", F.col("n.neighbour").alias("neighbour"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("n.far")).alias("similarity"))
