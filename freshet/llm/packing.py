"""Operator 3: packing of documents into sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces that fit a sequence.  Whole-sequence
pieces stand alone.  The others are dealt into groups of bounded size, and each
group is packed by several islands.  An individual is a list of bins.  Crossover
injects whole well-filled bins of one parent into the other, removes the bins
that hold any of the same pieces, and best-fits the pieces thus displaced.  Mutation takes
the emptiest bins apart and packs their pieces anew, by best fit or into tight bins.
After each epoch every island sends its best individuals to the next island of
its group.

Contract
--------
Null text counts as empty (one end token).  Repeated rows are packed as rows of
their own, null keys are kept, an empty table gives an empty result, extra
columns are left out.  Equal lengths are interchangeable; which of them shares a
sequence is decided by key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, groups_by_size, lean, only, sliced, staged
from .tokenise import encoder_of

PIECES = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``most``."""
    first = n % most or min(n, most)
    return [(0, first), *[(s, most) for s in range(first, n, most)]] if n else []


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, most: int = 1024, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``(key, piece, start, length, ids_crc32[, ids binary])``."""
    narrow = only(docs, key=id_column, text=text_column)
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, {PIECES}" + ", ids binary" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in sliced(batches):
            at = 0
            for part in groups_by_size([t or "" for t in batch.column(1).to_pylist()]):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, packed in enumerate(encoder.batch(part)):
                    packed += end
                    for k, (s, n) in enumerate(cut(len(packed) // 4, most)):
                        own = packed[4 * s : 4 * (s + n)]
                        rows.append(at + i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                at += len(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(lean(run), schema)


class Packing:
    """One individual: bins of item numbers and the space left in each."""

    __slots__ = ("bins", "left")

    def __init__(self, bins: list[list[int]], left: list[int]):
        self.bins, self.left = bins, left

    def fitness(self, most: int) -> float:
        """Mean squared fill; of packings with as few bins, the one with fuller bins wins."""
        fill = 1 - np.asarray(self.left) / most
        return float((fill**2).mean()) if len(fill) else 1.0


def best_fit(packing: Packing, items: list[int], lengths: list[int], most: int) -> Packing:
    """Put items, the longest first, each where the least space is left over."""
    bins, left = packing.bins, packing.left
    free = sorted((space, i) for i, space in enumerate(left) if space)
    for item in sorted(items, key=lambda x: (-lengths[x], x)):
        n = lengths[item]
        at = bisect_left(free, (n, -1))
        if at == len(free):
            i = len(bins)
            bins.append([item])
            left.append(most - n)
        else:
            _, i = free.pop(at)
            bins[i].append(item)
            left[i] -= n
        if left[i]:
            insort(free, (left[i], i))
    return packing


def crossover(mother: Packing, father: Packing, lengths: list[int], most: int, rng: np.random.Generator, share: float) -> Packing:
    """A copy of ``mother`` with well-filled bins of ``father`` injected."""
    full = np.argsort(np.asarray(father.left), kind="stable")
    well = full[: max(1, len(full) // 2)]
    chosen = rng.choice(well, size=max(1, int(share * len(well))), replace=False).tolist()
    injected = {x for i in chosen for x in father.bins[i]}
    bins, left, displaced = [], [], []
    for items, space in zip(mother.bins, mother.left):
        if injected.isdisjoint(items):
            bins.append(list(items))
            left.append(space)
        else:
            displaced += [x for x in items if x not in injected]
    bins += [list(father.bins[i]) for i in chosen]
    left += [father.left[i] for i in chosen]
    return best_fit(Packing(bins, left), displaced, lengths, most)


def tight_bins(lengths: list[int], most: int, rng: np.random.Generator | None = None) -> Packing:
    """Bins that each begin with the longest item left and take the one or two others that leave the least space, again until none fits.

    Of equal choices it takes the longest item, or with ``rng`` any.
    """
    own: list[list[int]] = [[] for _ in range(most + 1)]
    for i, n in enumerate(lengths):
        own[n].append(i)
    count = np.array([len(x) for x in own])
    packing, longest = Packing([], []), most

    def take(n: int) -> int:
        count[n] -= 1
        return own[n].pop()

    for _ in range(len(lengths)):
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            break
        items, room = [take(longest)], most - longest
        while room and len(have := np.flatnonzero(count[: room + 1])):
            chosen, least = (int(have[-1]),), room - int(have[-1])
            if least:
                at = np.searchsorted(have, room - have, side="right") - 1
                one, two = have[at >= 0], have[at[at >= 0]]
                able = (one != two) | (count[one] > 1)
                one, two = one[able], two[able]
                space = room - one - two
                if len(space) and space.min() < least:
                    best = np.flatnonzero(space == space.min())
                    k = best[-1] if rng is None else rng.choice(best)
                    chosen = int(one[k]), int(two[k])
            items += [take(n) for n in chosen]
            room -= sum(chosen)
        packing.bins.append(items)
        packing.left.append(room)
    return packing


def mutate(packing: Packing, lengths: list[int], most: int, rng: np.random.Generator, share: float) -> Packing:
    """Take apart the emptiest bins and as many others, then pack their items by best fit or into tight bins."""
    n = len(packing.bins)
    if not n:
        return Packing([], [])
    size = max(2, int(share * n))
    gone = {*np.argsort(-np.asarray(packing.left), kind="stable")[:size].tolist(), *rng.integers(0, n, size=size).tolist()}
    items = sorted((x for i in gone for x in packing.bins[i]), key=lambda x: (lengths[x], x))
    kept = [i for i in range(n) if i not in gone]
    rest = Packing([list(packing.bins[i]) for i in kept], [packing.left[i] for i in kept])
    if rng.random() < 0.5:
        return best_fit(rest, items, lengths, most)
    new = tight_bins([lengths[x] for x in items], most, rng)
    return Packing([*rest.bins, *[[items[i] for i in own] for own in new.bins]], [*rest.left, *new.left])


def first_generation(lengths: list[int], most: int, rng: np.random.Generator, size: int) -> list[Packing]:
    """Best fit of all items, the longest first; tight bins of several kinds; mutants of the first."""
    base = best_fit(Packing([], []), list(range(len(lengths))), lengths, most)
    people = [base, tight_bins(lengths, most), *[tight_bins(lengths, most, rng) for _ in range(size // 2 - 1)]]
    return [*people, *[mutate(base, lengths, most, rng, 0.2) for _ in range(size - len(people))]][:size]


def evolve(population: list[Packing], lengths: list[int], most: int, generations: int, rng: np.random.Generator) -> list[Packing]:
    """Steady-state evolution: a child takes the worst individual's place if it is fitter.

    It ends early where there are as few bins as the sum of lengths allows.
    """
    least = -(-sum(lengths) // most)
    score = [(len(p.bins), -p.fitness(most)) for p in population]
    for _ in range(generations):
        if min(score)[0] <= least or len(population) < 2:
            break
        a, b = rng.choice(len(population), size=2, replace=False).tolist()
        child = population[a]
        if rng.random() < 0.5:
            child = crossover(child, population[b], lengths, most, rng, float(rng.choice([0.1, 0.5, 1.0])))
        child = mutate(child, lengths, most, rng, float(rng.choice([0.005, 0.02, 0.08, 0.2])))
        new, worst = (len(child.bins), -child.fitness(most)), max(range(len(score)), key=score.__getitem__)
        if new < score[worst]:
            population[worst], score[worst] = child, new
    return population


def _packed(p: Packing, n: int) -> bytes:
    of = np.empty(n, dtype="<i4")
    for i, items in enumerate(p.bins):
        of[items] = i
    return of.tobytes()


def _unpacked(data: bytes, lengths: list[int], most: int) -> Packing:
    of = np.frombuffer(data, dtype="<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    left = [most] * len(bins)
    for item, i in enumerate(of.tolist()):
        bins[i].append(item)
        left[i] -= lengths[item]
    return Packing(bins, left)


def pack_pieces(pieces: DataFrame, most: int = 1024, group_items: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 40, population: int = 6, elite: int = 1) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(key, piece, length, ...)``.

    ``pieces`` should be staged: it is read more than once.  Groups hold about
    ``group_items`` pieces whatever the input, so tasks are bounded and their number
    grows with the input; each group wastes less than one sequence.
    """
    full = pieces.where(F.col("length") == most).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < most)
    groups = max(1, round(short.count() / group_items))
    # rows with the same key are dealt apart by what they hold
    dealt = staged(short.withColumn("grp", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))), "pack-groups")
    order = ["length", "key", "piece", "ids_crc32"]

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = sorted(rows["length"].tolist())
        out = []
        for island in range(islands):
            rng = np.random.default_rng([int(key[0]), island])
            people = first_generation(lengths, most, rng, population)
            out += [(key[0], island, np.array(lengths, dtype="<i4").tobytes(), _packed(p, len(lengths))) for p in people]
        return pd.DataFrame(out, columns=["grp", "island", "lengths", "bin_of"])

    state_schema = "grp long, island int, lengths binary, bin_of binary"
    state = dealt.groupBy("grp").applyInPandas(begin, state_schema)

    def epoch_of(epoch: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lengths = np.frombuffer(rows["lengths"].iloc[0], dtype="<i4").tolist()
            rng = np.random.default_rng([int(key[0]), int(key[1]), epoch])
            people = evolve([_unpacked(x, lengths, most) for x in sorted(rows["bin_of"])], lengths, most, generations, rng)
            people.sort(key=lambda p: (len(p.bins), -p.fitness(most)))
            stay = [(key[0], key[1], rows["lengths"].iloc[0], _packed(p, len(lengths))) for p in people]
            leave = [(key[0], (key[1] + 1) % islands, *x[2:]) for x in stay[:elite]]
            return pd.DataFrame([*stay, *leave], columns=["grp", "island", "lengths", "bin_of"])

        return run

    for epoch in range(epochs):
        state = state.groupBy("grp", "island").applyInPandas(epoch_of(epoch), state_schema)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def settle(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        lengths = rows["length"].tolist()
        best = min((_unpacked(x, lengths, most) for x in sorted(states["bin_of"])), key=lambda p: (len(p.bins), -p.fitness(most)), default=Packing([], []))
        sequence, offset = np.empty(len(rows), dtype="int64"), np.empty(len(rows), dtype="int64")
        for i, items in enumerate(best.bins):
            at = 0
            for item in items:
                sequence[item], offset[item] = int(key[0]) * 2**24 + i, at
                at += lengths[item]
        return rows.assign(sequence_id=sequence, offset=offset).drop(columns="grp")

    settled = dealt.groupBy("grp").cogroup(state.groupBy("grp")).applyInPandas(settle, f"{fields}, sequence_id long, offset long")
    return settled.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, most: int = 1024, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack: ``(<id>, piece, start, length, ids_crc32[, ids], sequence_id, offset)``."""
    pieces = staged(tokenised_pieces(docs, tokenizer_path, end_id, most, id_column=id_column, text_column=text_column, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, most, **options).withColumnRenamed("key", id_column)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
