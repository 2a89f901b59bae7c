"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages; a passage is a TF-IDF vector over the terms of the benchmark, for no other term adds to a product with a
benchmark item. A randomised singular value decomposition over all passages gives a small basis: each task adds up A'(A G) of its
passages for a random G, Spark sums the parts, and the driver orthonormalises a matrix whose size is columns x rank and nothing
else. Windows of a text are compared with the items in that basis. Windows that are close enough are checked word by
word: the longest common subsequence with the item, and that of the item's answer, its last sentence.

Words are looked up once: texts become term numbers in the shared folder, and the later passes read those.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspan.llm.common import bounded, settle, shared

#: Columns of the passage matrix at most; beyond so many terms, some share one.
COLUMNS = 16_384
#: Words of the benchmark that are looked for in one run over the texts; a larger benchmark takes several.
BLOCK_WORDS = 50_000
#: Words that one step of a task works on.
AT_ONCE = 300_000
#: Passages whose terms are marked in one table.
TALLIED = 512
#: Windows are compared with the items so many at a time.
TILE = 4_096
#: Rarest terms of an item that a window must hold at least to have its terms counted.
PROBES = 4
#: Pairs of a rare term's place and an item that are held at once.
PAIRS = 4_000_000
_SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_SENTENCE = re.compile(r"[.!?]+\s+")


@dataclass(frozen=True)
class Settings:
    """`rank`: of the basis. `passage`: words of a passage. `cell`: words by which windows start. `common`: share of passages from which a
    term has no weight. `cosine`: least cosine of a candidate. `overlap`: least share of an item's words in order; from `verbatim` on, the
    answer needs no check. `answer`: least share of the answer's words. `least_words`: shorter items are not looked for, and so many
    words, or all of a shorter item, must be found."""

    rank: int = 96
    passage: int = 64
    cell: int = 16
    common: float = 0.02
    cosine: float = 0.45
    overlap: float = 0.6
    verbatim: float = 0.8
    answer: float = 0.5
    least_words: int = 8
    shortest: int = 4
    seed: int = 20


def words(text: str | None) -> list[bytes]:
    """Words in lower case, cut at every ASCII character that is neither letter nor digit."""
    return text.lower().encode().translate(_TABLE).split() if text else []


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    answer: np.ndarray


class Index:
    """The items of one block: their terms, and what is learned of them from the corpus."""

    def __init__(self, rows: list[tuple[int, str]], settings: Settings) -> None:
        self.settings = settings
        found = [(key, words(text), words(_SENTENCE.split(text.strip())[-1])) for key, text in rows]
        found = [x for x in found if len(x[1]) >= settings.shortest]
        self.terms = {w: i for i, w in enumerate(sorted({w for _, ws, _ in found for w in ws}))}
        self.items = [Item(key, self.ids(ws), self.ids(answer)) for key, ws, answer in found]
        self.columns = max(1, min(COLUMNS, len(self.terms)))
        self.weights = np.zeros(len(self.terms), np.float32)
        self.basis = np.zeros((self.columns, 1), np.float32)

    def ids(self, found: list[bytes]) -> np.ndarray:
        get = self.terms.get
        return np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))

    def weigh(self, frequencies: np.ndarray, passages: int) -> None:
        """Inverse document frequencies; common terms get no weight but in items that have no other."""
        idf = np.log((passages + 1) / (frequencies + 1))
        rare = frequencies <= self.settings.common * passages
        for item in self.items:
            if not rare[item.ids].any():
                rare[item.ids] = True
        self.weights = np.where(rare, idf, 0).astype(np.float32)
        self._probe(frequencies)

    def _probe(self, frequencies: np.ndarray) -> None:
        """For the exact search, the items that each term is a probe of.

        Of an item's D different terms a window must hold `different`, for each missing word takes one away at most. As many of them as
        `probes` are then among the D - different + probes rarest.
        """
        self.different, self.probes = np.ones(len(self.items), np.int64), np.ones(len(self.items), np.int64)
        self.has = np.zeros((len(self.terms) + 1, len(self.items)), bool)
        pairs = []
        for k, item in enumerate(self.items):
            terms = np.unique(item.ids)
            self.has[terms, k] = True
            need = max(int(np.ceil(self.settings.overlap * len(item.ids) - 1e-9)), min(self.settings.least_words, len(item.ids)))
            self.different[k] = max(1, len(terms) - len(item.ids) + need)
            self.probes[k] = min(PROBES, self.different[k])
            rarest = terms[np.argsort(frequencies[terms], kind="stable")][:len(terms) - self.different[k] + self.probes[k]]
            pairs += [(t, k) for t in rarest.tolist()]
        term, item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.probed = np.searchsorted(term, np.arange(len(self.terms) + 1)), item

    def project(self, basis: np.ndarray) -> None:
        """Items in the basis, by the number of cells a window needs to hold them wherever it starts."""
        self.basis = basis.astype(np.float32)
        cell = self.settings.cell
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([-(-len(x.ids) // cell) + 1 for x in self.items])
        for size in sorted(set(sizes.tolist())):
            members = np.nonzero(sizes == size)[0]
            vectors = np.stack([self.latent(self.items[k].ids).sum(0) for k in members])
            self.classes[size] = members, _unit(vectors)
        # As many different weighty terms must be in a window as remain when the allowed share of words is missing.
        self.holds = np.zeros((len(self.terms) + 1, len(self.items)), bool)
        self.least = np.zeros(len(self.items), np.int64)
        for k, item in enumerate(self.items):
            weighty = np.unique(item.ids[self.weights[item.ids] > 0])
            self.holds[weighty, k] = True
            self.least[k] = np.ceil(len(weighty) - (1 - self.settings.overlap) * len(item.ids) - 1e-9)
        self.masks = [(_masks(x.ids), _masks(x.answer)) for x in self.items]

    def latent(self, ids: np.ndarray) -> np.ndarray:
        return self.basis[ids % self.columns] * self.weights[ids][:, None]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _masks(ids: np.ndarray) -> tuple[int, dict[int, int]]:
    """Length, and the places of each term as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(ids.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    return len(ids), places


def common_length(masks: tuple[int, dict[int, int]], sequence: list[int]) -> int:
    """Length of the longest common subsequence, all places of one text at once as the bits of a number."""
    n, places = masks
    full = (1 << n) - 1
    open_ = full
    for x in sequence:
        met = open_ & places.get(x, 0)
        if met:
            open_ = ((open_ + met) | (open_ - met)) & full
    return n - open_.bit_count()


def _passage_terms(flat: np.ndarray, lengths: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, int]:
    """Term and passage of every known term of some texts, and the number of passages."""
    size = index.settings.passage
    many = np.maximum(1, -(-lengths // size))
    first = np.concatenate(([0], np.cumsum(many)[:-1]))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(len(flat)) - np.repeat(starts, lengths)
    passage = np.repeat(first, lengths) + inside // size
    known = flat >= 0
    return flat[known], passage[known], int(many.sum())


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _slices(batches: Iterator[pa.RecordBatch], words_at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(batch.column("ids").offsets.to_numpy())
        cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(words_at_once, sizes.sum(), words_at_once)) + 1)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _term_numbers(docs: DataFrame, index: Index) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            ids = [index.ids(words(t.as_py())) for t in batch.column("text")]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id bigint, ids array<int>")


def _frequencies(numbers: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""
    size = len(index.terms)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in _slices(batches):
            term, passage, many = _passage_terms(*_flat(batch), index)
            total[size] += many
            for first in range(0, many, TALLIED):
                own = slice(*np.searchsorted(passage, (first, first + TALLIED)))
                held = np.zeros((TALLIED, size), bool)
                held[passage[own] - first, term[own]] = True
                total[:size] += held.sum(0)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(size + 1, np.int64)
    for row in numbers.select("ids").mapInArrow(of, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out[:size], int(out[size])


def _summed(numbers: DataFrame, index: Index, left: np.ndarray) -> np.ndarray:
    """A'(A left) over all passages: every task adds up its own, Spark adds the tasks' rows by column number."""
    model = shared(numbers.sparkSession, (index, np.ascontiguousarray(left.T)))
    rank = left.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, left = model()
        total = np.zeros((index.columns, rank), np.float64)
        for batch in _slices(batches):
            term, passage, many = _passage_terms(*_flat(batch), index)
            heavy = index.weights[term] > 0
            term, passage = term[heavy], passage[heavy]
            column, weight = term % index.columns, index.weights[term]
            for k in range(rank):
                projected = np.bincount(passage, weights=left[k][column] * weight, minlength=many)
                total[:, k] += np.bincount(column, weights=projected[passage] * weight, minlength=index.columns)
        at = np.nonzero(total.any(1))[0]
        values = pa.array(total[at].astype(np.float32).ravel())
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * rank)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(offsets, values)], names=["col", "row"])

    parts = numbers.select("ids").mapInArrow(of, "col int, row array<float>")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("row").flatten().to_numpy().reshape(-1, rank)
            for c, row in zip(batch.column("col").to_pylist(), rows, strict=True):
                total[c] = total[c] + row if c in total else row.astype(np.float64)
        if total:
            values = pa.array(np.concatenate(list(total.values())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * rank), values)], names=["col", "row"])

    out = np.zeros((index.columns, rank))
    for row in parts.repartition("col").mapInArrow(add, "col int, row array<float>").toLocalIterator():
        out[row["col"]] = row["row"]
    return out


def _learn(numbers: DataFrame, index: Index) -> None:
    """Weights and basis of the index from all passages.

    The passages' covariance C = A'A meets a random matrix G once. From Y = C G alone, C is close to Y (G'Y)^-1 Y' (Nystrom), whose
    eigenvectors are the right singular vectors of A and whose eigenvalues are the squares of its singular values. A small multiple of G is
    added first and taken off the eigenvalues, which keeps the factorisation stable.
    """
    index.weigh(*_frequencies(numbers, index))
    rank = min(index.settings.rank, index.columns)
    random = np.random.default_rng(index.settings.seed).standard_normal((index.columns, rank))
    random, _ = np.linalg.qr(random)
    met = _summed(numbers, index, random)
    shift = 1e-6 * max(float(np.linalg.norm(met)), 1e-12)
    met = met + shift * random
    inner = random.T @ met
    factor = np.linalg.cholesky((inner + inner.T) / 2)
    vectors, values, _ = np.linalg.svd(np.linalg.solve(factor, met.T).T, full_matrices=False)
    index.singular = np.sqrt(np.maximum(values**2 - shift, 0))
    index.project(vectors)


def _probed(flat: np.ndarray, places: np.ndarray, size: int, most: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """First cell and item of every window that holds as many different terms of the item as the overlap asks for.

    `places` has each word's place, `size` is the number of cells; the last `most` cells are empty.
    """
    cell = index.settings.cell
    starts, items = index.probed
    sizes = np.array([-(-len(x.ids) // cell) + 1 for x in index.items])
    at = np.nonzero(flat >= 0)[0]
    met = starts[flat[at] + 1] - starts[flat[at]]
    at, met = at[met > 0], met[met > 0]
    ends, found = np.cumsum(met), []
    for a, b in itertools.pairwise([0, *(np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) + 1).tolist(), len(at)] if len(at) else []):
        own, many = at[a:b], met[a:b]
        item = items[np.repeat(starts[flat[own]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        found.append(np.unique(item * size + np.repeat(places[own] // cell, many), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, which = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    total = np.concatenate(([0], np.cumsum(np.bincount(which, weights=np.concatenate([x[1] for x in found])).astype(np.int64))))
    item, first = keys // size, keys % size
    chosen = []
    for back in range(most):
        able = (back < sizes[item]) & (back <= first)
        own, start = item[able], keys[able] - back
        count = total[np.searchsorted(keys, start + sizes[own])] - total[np.searchsorted(keys, start)]
        chosen.append(start[count >= index.probes[own]])
    keys = np.unique(np.concatenate(chosen))
    # The words of all cells, so that the different terms of a window can be counted.
    words = np.full(size * cell, -1, np.int32)
    words[places] = flat
    out = []
    for n in np.unique(sizes).tolist():
        same = keys[sizes[keys // size] == n]
        for i in range(0, len(same), TILE):
            item, first = same[i:i + TILE] // size, same[i:i + TILE] % size
            held = np.sort(words[first[:, None] * cell + np.arange(n * cell)], axis=1)
            new = np.concatenate([np.ones((len(held), 1), bool), held[:, 1:] != held[:, :-1]], axis=1)
            out.append(same[i:i + TILE][(index.has[held, item[:, None]] & new).sum(1) >= index.different[item]])
    keys = np.concatenate(out) if out else keys
    return keys % size, keys // size


def _candidates(ids: list[np.ndarray], index: Index) -> Iterator[tuple[int, int, int, int, float]]:
    """Windows to be checked word by word: (text, first word, last word, item, cosine).

    Those that are close to an item and hold enough of its weighty terms, and those that the exact search finds.
    """
    cell, most = index.settings.cell, max(index.classes)
    many = np.array([-(-len(x) // cell) for x in ids])
    first = np.concatenate(([0], np.cumsum(many + most)[:-1]))
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    lengths = np.array([len(x) for x in ids])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    size = int(first[-1] + many[-1] + most)
    places = np.repeat(first * cell - starts, lengths) + np.arange(len(flat))
    exact = _probed(flat, places, size, most, index)
    at = np.nonzero(flat >= 0)[0]
    at = at[index.weights[flat[at]] > 0]
    cells = places[at] // cell
    column, weight = flat[at] % index.columns, index.weights[flat[at]]
    sums = np.empty((index.basis.shape[1], size), np.float32)
    for k, axis in enumerate(np.ascontiguousarray(index.basis.T)):
        sums[k] = np.bincount(cells, weights=axis[column] * weight, minlength=size)
    sums = np.ascontiguousarray(sums.T)
    terms = np.full((size, cell), -1, np.int32)
    terms[cells, places[at] % cell] = flat[at]
    seen = [np.zeros(0, np.int64)]

    def _placed(row: np.ndarray, item: np.ndarray, n: int, cosines: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        texts = np.searchsorted(first, row, "right") - 1
        begin = (row - first[texts]) * cell
        end = np.minimum(begin + n * cell, lengths[texts])
        inside = begin < end
        return zip(*(x[inside].tolist() for x in (texts, begin, end, item, cosines)), strict=True)

    for i in range(0, size - most, TILE):
        stop = min(i + TILE, size - most)
        window = sums[i:stop].copy()
        for n in range(2, most + 1):
            window += sums[i + n - 1:stop + n - 1]
            if n not in index.classes:
                continue
            members, vectors = index.classes[n]
            norms = np.sqrt(np.einsum("ij,ij->i", window, window))
            found = window @ vectors.T
            row, col = np.nonzero((found >= index.settings.cosine * norms[:, None]) & (norms[:, None] > 0))
            item = members[col]
            held = sum(index.holds[terms[row + i + j], item[:, None]].sum(1) for j in range(n))
            row, col, item = (x[held >= index.least[item]] for x in (row, col, item))
            seen.append(item * size + row + i)
            yield from _placed(row + i, item, n, found[row, col] / norms[row])
    row, item = exact
    new = ~np.isin(item * size + row, np.concatenate(seen))
    row, item = row[new], item[new]
    for n, (members, vectors) in index.classes.items():
        own = np.isin(item, members)
        window = _unit(sum(sums[row[own] + j] for j in range(n)))
        cosines = np.einsum("ij,ij->i", window, vectors[np.searchsorted(members, item[own])])
        yield from _placed(row[own], item[own], n, cosines)


def _confirmed(ids: list[np.ndarray], index: Index) -> dict[tuple[int, int], tuple[float, float, float, int, int]]:
    """For each text and item that holds: the best (overlap, answer, cosine, first word, words of the window)."""
    found: dict[tuple[int, int], tuple[float, float, float, int, int]] = {}
    need = index.settings
    for text, start, stop, k, cosine in _candidates(ids, index):
        whole, answer = index.masks[k]
        window = ids[text][start:stop].tolist()
        length = common_length(whole, window)
        share = length / whole[0]
        if share < need.overlap or length < min(need.least_words, whole[0]):
            continue
        answered = common_length(answer, window) / answer[0] if answer[0] else 1.0
        if share < need.verbatim and answered < need.answer:
            continue
        best = (share, answered, cosine, -start, start - stop)
        if (text, k) not in found or best > found[text, k]:
            found[text, k] = best
    return {key: (s, a, c, -p, -n) for key, (s, a, c, p, n) in found.items()}


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """Indexes over the benchmark's items, a bounded number of words at a time; the driver holds one block."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.filter("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"]) // 6 + 1
        if held and size + n > BLOCK_WORDS:
            yield Index(held, settings)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield Index(held, settings)


LEAKS = "doc_id bigint, item_id bigint, overlap double, answer double, cosine double, first_word bigint, n_words bigint"


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Documents that hold benchmark items, word for word or in other words: rows LEAKS, one for each document and item.

    `overlap` is the share of the item's words found in order within a window of the text, `answer` that of its last sentence. Items of fewer than
    `shortest` words and null items are not looked for. Null and empty texts hold nothing; texts of any length are searched whole.
    Documents or items given several times count once; those with a null id are reported under null. Of several places the best
    overlap, then answer, cosine and first place are returned. Other columns are ignored; empty tables give an empty table.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    found = None
    for index in _blocks(benchmark, settings):
        if not index.items:
            continue
        numbers = settle(_term_numbers(docs, index), "terms")
        _learn(numbers, index)
        model = shared(spark, index)

        def search(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            index = model()
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64())
            for batch in _slices(batches):
                flat, lengths = _flat(batch)
                ids = np.split(flat, np.cumsum(lengths)[:-1])
                keys = batch.column("doc_id").to_pylist()
                rows = [(keys[text], index.items[k].item_id, *values) for (text, k), values in _confirmed(ids, index).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LEAKS.split(", ")])

        part = numbers.mapInArrow(search, LEAKS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], LEAKS)
    best = F.max(F.struct("overlap", "answer", "cosine", (-F.col("first_word")).alias("p"), (-F.col("n_words")).alias("n"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.overlap", "best.answer", "best.cosine", (-F.col("best.p")).alias("first_word"), (-F.col("best.n")).alias("n_words"))


def _clean(model: Callable[[], Index]):
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = model()
        for texts in batches:
            out = np.ones(len(texts), bool)
            held: list[np.ndarray] = []
            size = 0
            for i, text in enumerate(texts):
                held.append(index.ids(words(text)))
                size += len(held[-1])
                if size > AT_ONCE or i == len(texts) - 1:
                    first = i + 1 - len(held)
                    out[[first + text for text, _ in _confirmed(held, index)]] = False
                    held, size = [], 0
            yield pd.Series(out)

    return of


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs` that hold no benchmark item. All columns are kept, whatever their names; nothing is joined back."""
    settings = settings or Settings()
    kept = docs
    for index in _blocks(benchmark, settings):
        if not index.items:
            continue
        numbers = settle(_term_numbers(docs, index), "terms")
        _learn(numbers, index)
        kept = kept.filter(F.pandas_udf(_clean(shared(docs.sparkSession, index)), "boolean")(F.col("text")))
    return kept
