"""Byte-level BPE by recursive queries: every partition encodes and decodes its texts in a DuckDB of its own, in memory.

A text is split into words by the vocabulary's pattern. Words that the partition has not met yet become rows of (word, position, token), one for each byte. A recursive
query joins neighbours with the merge table and contracts each word's leftmost pair of least rank, until no pair of the word is in the table. The merge table has every way in which
a token is made of two others, because the ranks alone say which pair is next. In long words further places of that rank are contracted in the same step where they would
come next anyway, so a long run takes about as many steps as it has different merges.

Ids go back to bytes by joining them with the vocabulary and aggregating in order of position. Both directions pass a bounded number of words at a time, so a
text of any length adds up to its digests piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallyspan.llm.common import bounded, shared

#: Words that pass through a query at once, and characters of a text that are split at once.
WORDS = 400_000
#: Encoded words that a partition remembers; then it starts anew.
KNOWN = 1_000_000
#: Bytes of the new words of one recursive query.
NEW_BYTES = 200_000
MEMORY = "700MB"


@dataclass(frozen=True)
class Vocabulary:
    """`pieces`: the bytes of every token, by rank. `pattern`: what a text is split by. `merges`: rows (left, right, rank) of numbers.

    A broadcast vocabulary is as large as its file, whatever the input.
    """

    pieces: list[bytes]
    pattern: str
    merges: np.ndarray

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines `base64 rank`. Every single byte must be a token and ranks must not leave a number out."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pieces: list[bytes | None] = [None] * len(ranks)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        if None in pieces or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a rank or a single byte is missing")
        rows = [(left, right, rank) for piece, rank in ranks.items() for k in range(1, len(piece))
                if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None]
        return cls(pieces, pattern, np.array(rows, np.int32).reshape(-1, 3))


#: Bytes of the longest word that is contracted one place at a time.
SHORT = 64

_BEGIN = "SELECT word, position, after, token, next, rank, 0 AS step FROM begun LEFT JOIN merges ON token = l AND next = r"
_IDS = "SELECT text, list(token ORDER BY position) AS ids FROM settled JOIN fresh USING (word) GROUP BY word, text"

#: A row is a token with the place and token after it and the rank of that pair. Words without a pair in the table leave the recursion.
_CONTRACT_SHORT = f"""
INSERT INTO known
WITH RECURSIVE parts AS (
  {_BEGIN}
  UNION ALL
  (WITH least AS (
    SELECT word, min((rank::BIGINT << 32) | position) AS pair, arg_min(after, (rank::BIGINT << 32) | position) AS gone
    FROM parts WHERE rank IS NOT NULL GROUP BY word),
  made AS (
    SELECT m.word, (pair & 4294967295)::INTEGER AS position, (pair >> 32)::INTEGER AS rank, gone, q.after, q.next
    FROM least m JOIN parts q ON q.word = m.word AND q.position = gone)
  SELECT word, position, after, token, next, CASE WHEN tested IS NULL THEN moved.rank ELSE x.rank END AS rank, step FROM (
    SELECT p.word, p.position, p.rank, step + 1 AS step, CASE WHEN p.position = m.position THEN m.after ELSE p.after END AS after,
      CASE WHEN p.position = m.position THEN m.rank ELSE p.token END AS token,
      CASE WHEN p.position = m.position THEN m.next WHEN p.after = m.position THEN m.rank ELSE p.next END AS next,
      CASE WHEN p.position = m.position THEN m.rank WHEN p.after = m.position THEN p.token END AS tested
    FROM parts p JOIN made m ON m.word = p.word WHERE p.position <> m.gone) moved
  LEFT JOIN merges x ON tested = l AND next = r)
), settled AS (SELECT word, position, token FROM parts JOIN (SELECT word, max(step) AS step FROM parts WHERE position = 0 GROUP BY word) USING (word, step))
{_IDS}
"""

#: Steps of a long word in one query; what is not done then goes on in the next one.
STEPS = 48

#: The same for long words, many places of the least rank at once: of places that follow each other without a gap, every second one. From the left, up to the first
#: whose contraction makes a pair of that rank or a lower one, for then that pair would come next.
_CONTRACT_LONG = f"""
CREATE OR REPLACE TABLE ahead AS
WITH RECURSIVE parts AS (
  SELECT word, position, after, token, next, rank, 0 AS step FROM state
  UNION ALL
  (WITH least AS (SELECT word, min(rank) AS rank FROM parts WHERE rank IS NOT NULL AND step < {STEPS} GROUP BY word),
  places AS (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY position) AS nth FROM (
        SELECT *, count(*) FILTER (follows IS NOT TRUE) OVER (PARTITION BY word ORDER BY position) AS run FROM (
          SELECT p.*, lag(p.after) OVER (PARTITION BY p.word ORDER BY p.position) = p.position AS follows FROM parts p JOIN least USING (word, rank))))
    WHERE nth % 2 = 1),
  judged AS (
    SELECT c.word, c.position, c.rank, c.after AS gone, q.after, q.next, coalesce(x.rank <= c.rank, false) OR coalesce(y.rank <= c.rank, false) AS turns
    FROM places c JOIN parts q ON q.word = c.word AND q.position = c.after
    LEFT JOIN parts o ON o.word = c.word AND o.after = c.position LEFT JOIN places g ON g.word = c.word AND g.after = o.position
    LEFT JOIN merges x ON x.l = coalesce(g.rank, o.token) AND x.r = c.rank LEFT JOIN merges y ON y.l = c.rank AND y.r = q.next),
  made AS (
    SELECT * FROM (SELECT *, count(*) FILTER (turns) OVER (PARTITION BY word ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turned FROM judged)
    WHERE turned = 0),
  moved AS (
    SELECT p.word, p.position, coalesce(m.after, p.after) AS after, coalesce(m.rank, p.token) AS token,
      CASE WHEN m.rank IS NULL THEN p.next ELSE m.next END AS next, step + 1 AS step
    FROM parts p SEMI JOIN least USING (word) LEFT JOIN made m ON m.word = p.word AND m.position = p.position
    ANTI JOIN made g ON g.word = p.word AND g.gone = p.position)
  SELECT v.word, v.position, v.after, v.token, coalesce(o.rank, v.next) AS next, x.rank, step
  FROM moved v LEFT JOIN made o ON o.word = v.word AND o.position = v.after LEFT JOIN merges x ON v.token = l AND coalesce(o.rank, v.next) = r)
)
SELECT word, position, after, token, next, rank FROM parts JOIN (SELECT word, max(step) AS step FROM parts GROUP BY word) USING (word, step)
"""


class Coder:
    """Encodes and decodes words in a database in memory, one thread of it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._split = regex.compile(vocabulary.pattern)
        pieces = pa.table({"id": pa.array(np.arange(len(vocabulary.pieces), dtype=np.int32)), "piece": pa.array([p.hex() for p in vocabulary.pieces])})
        merges = pa.table({n: pa.array(np.ascontiguousarray(vocabulary.merges[:, i])) for i, n in enumerate(("l", "r", "rank"))})
        whole = [(p.decode(), i) for i, p in enumerate(vocabulary.pieces) if _is_text(p)]
        self._whole = pa.table({"text": pa.array([t for t, _ in whole]), "ids": pa.array([[i] for _, i in whole], pa.list_(pa.int32()))})
        self._bytes = np.zeros(256, np.int32)
        for i, p in enumerate(vocabulary.pieces):
            if len(p) == 1:
                self._bytes[p[0]] = i
        self.con.register("given_pieces", pieces)
        self.con.register("given_merges", merges)
        self.con.execute("CREATE TABLE pieces AS FROM given_pieces; CREATE TABLE merges AS FROM given_merges")
        self._restart()

    def _restart(self) -> None:
        """A word that is a token as a whole is that token, however its bytes might merge."""
        self.con.register("given_whole", self._whole)
        self.con.execute("CREATE OR REPLACE TABLE known AS SELECT text, ids::INTEGER[] AS ids FROM given_whole")
        self._seen = self._whole.num_rows

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a bounded number at a time."""
        if len(text) <= WORDS:
            yield self._split.findall(text)
            return
        found = (m[0] for m in self._split.finditer(text))
        while some := list(itertools.islice(found, WORDS)):
            yield some

    def encode(self, keys: np.ndarray, words: pa.Array) -> pa.Table:
        """Ids of rows of words, whose keys rise: a table (key, ids) by key, ids in order of the words."""
        if not len(words):
            return pa.table({"key": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        coded = words.dictionary_encode()
        self.con.register("distinct_words", pa.table({"word": pa.array(np.arange(len(coded.dictionary), dtype=np.int32)), "text": coded.dictionary}))
        if self._seen + len(new := self._new()) > KNOWN:
            self._restart()
            new = self._new()
        self._seen += len(new)
        self._learn(new)
        found = self.con.sql("SELECT ids FROM distinct_words JOIN known USING (text) ORDER BY word").to_arrow_table().column("ids").combine_chunks()
        lists = found.take(coded.indices)
        first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
        ends = np.concatenate((first, [len(keys)]))
        offsets = lists.offsets.to_numpy()[ends]
        return pa.table({"key": pa.array(keys[first]), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.values)})

    def _new(self) -> pa.Array:
        return self.con.sql("SELECT text FROM distinct_words ANTI JOIN known USING (text)").to_arrow_table().column("text").combine_chunks()

    def _learn(self, texts: pa.Array) -> None:
        """Contracts the pairs of new words."""
        if not len(texts):
            return
        sizes = pa.compute.binary_length(texts).to_numpy()
        for long, chosen in ((False, np.nonzero(sizes <= SHORT)[0]), (True, np.nonzero(sizes > SHORT)[0])):
            if len(chosen):
                part = np.cumsum(sizes[chosen]) // NEW_BYTES
                for some in np.split(chosen, np.nonzero(np.diff(part))[0] + 1):
                    self._contract(long, texts.take(pa.array(some)), sizes[some])

    def _contract(self, long: bool, texts: pa.Array, sizes: np.ndarray) -> None:
        raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
        number = np.arange(len(sizes), dtype=np.int32)
        word = np.repeat(number, sizes)
        begin = np.cumsum(sizes) - sizes
        position = (np.arange(len(raw)) - np.repeat(begin, sizes)).astype(np.int32)
        token = self._bytes[raw]
        is_last = position + 1 == np.repeat(sizes, sizes)
        self.con.register("begun", pa.table({
            "word": word, "position": position, "after": position + np.int32(1), "token": token, "next": pa.array(np.roll(token, -1), mask=is_last)}))
        self.con.register("fresh", pa.table({"word": number, "text": texts}))
        if not long:
            self.con.execute(_CONTRACT_SHORT)
            return
        self.con.execute("CREATE OR REPLACE TABLE state AS SELECT word, position, after, token, next, rank FROM begun LEFT JOIN merges ON token = l AND next = r")
        while self.con.sql("SELECT 1 FROM state WHERE rank IS NOT NULL LIMIT 1").fetchall():
            self.con.execute(_CONTRACT_LONG)
            self.con.execute("CREATE OR REPLACE TABLE state AS FROM ahead")
        self.con.execute(f"INSERT INTO known WITH settled AS (FROM state) {_IDS}")

    def decode(self, ids: pa.Table) -> pa.Table:
        """Bytes of rows (key, ids): a table (key, hexes) by key, the pieces of the ids in order of their positions."""
        self.con.register("coded", ids)
        # One thread aggregates the pieces in the order in which the sort hands them on; sorting within every group takes twice as long.
        return self.con.sql("""
            SELECT place >> 32 AS key, string_agg(piece, '') AS hexes FROM (
              SELECT place, piece FROM (SELECT (key << 32) | generate_subscripts(ids, 1) AS place, unnest(ids) AS id FROM coded) JOIN pieces USING (id) ORDER BY place)
            GROUP BY key ORDER BY key""").to_arrow_table()


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _groups(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, list[tuple[int, Any, bool]]]]:
    """Words of texts in groups of a bounded number: (number of the text, word), and of each text in the group: number, doc_id, whether it ends here."""
    keys: list[np.ndarray] = []
    words: list[str] = []
    parts: list[tuple[int, Any, bool]] = []
    n = 0
    for batch in bounded(batches, "text"):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            some: list[str] = []
            for following in itertools.chain(coder.words(text or ""), (None,)):
                if some:
                    keys.append(np.full(len(some), n))
                    words += some
                if following is None:
                    parts.append((n, doc, True))
                elif len(words) >= WORDS:
                    if some:
                        parts.append((n, doc, False))
                    yield np.concatenate(keys), pa.array(words, pa.string()), parts
                    keys, words, parts = [], [], []
                some = following
            n += 1
    if parts:
        yield np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.array(words, pa.string()), parts


ENCODED = "doc_id bigint, part int, ids array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _encode(model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(model()), 0
        for keys, words, parts in _groups(coder, batches):
            found = coder.encode(keys, words)
            place = {k: i for i, k in enumerate(found.column("key").to_pylist())}
            lists = found.column("ids").combine_chunks()
            rows = pa.array([place.get(n) for n, _, _ in parts], pa.int64())
            numbers = []
            for _, _, ends in parts:
                numbers.append(part)
                part = 0 if ends else part + 1
            ids = pa.compute.if_else(pa.compute.is_null(rows), pa.scalar([], lists.type), lists.take(rows)) if len(lists) else pa.array([[]] * len(parts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d, _ in parts], pa.int64()), pa.array(numbers, pa.int32()), ids.cast(pa.list_(pa.int32()))], names=["doc_id", "part", "ids"])

    return of


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Token ids of every text: rows (doc_id, part, ids).

    A text of more than WORDS words comes in several rows, numbered from 0, whose ids are joined in that order. Null and empty texts have one row without ids. Repeated rows
    stay repeated; a null doc_id stays null. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(shared(docs.sparkSession, vocabulary)), ENCODED)


def _decode(model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model())
        for batch in batches:
            # Rows of a bounded number of ids at a time.
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy())
            cuts = sorted({0, *(np.nonzero(np.diff(sizes // (2 * WORDS)))[0] + 1).tolist(), batch.num_rows})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(a, b - a)
                found = coder.decode(pa.table({"key": pa.array(np.arange(b - a)), "ids": some.column("ids")}))
                texts = dict(zip(found.column("key").to_pylist(), found.column("hexes").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), pa.array([bytes.fromhex(texts.get(i, "")) for i in range(b - a)], pa.binary())],
                                                 names=["doc_id", "part", "bytes"])

    return of


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Bytes of rows of ids: rows (doc_id, part, bytes). Null and empty ids have no bytes; an id that the vocabulary lacks has none either."""
    return encoded.select("doc_id", "part", "ids").mapInArrow(_decode(shared(encoded.sparkSession, vocabulary)), "doc_id bigint, part int, bytes binary")


def _round_trip(model):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model())
        ids_digest, bytes_digest, many = hashlib.sha256(), hashlib.sha256(), 0
        for keys, words, parts in _groups(coder, batches):
            coded = coder.encode(keys, words)
            lists = {k: ids for k, ids in zip(coded.column("key").to_pylist(), _joined(coded.column("ids").combine_chunks()), strict=True)}
            decoded = coder.decode(coded)
            texts = dict(zip(decoded.column("key").to_pylist(), decoded.column("hexes").to_pylist(), strict=True))
            done = []
            for n, doc, ends in parts:
                n_ids, ids = lists.get(n, (0, b""))
                if n_ids:
                    ids_digest.update((b"," if many else b"") + ids)
                    bytes_digest.update(bytes.fromhex(texts[n]))
                    many += n_ids
                if ends:
                    done.append((doc, many, ids_digest.hexdigest(), bytes_digest.hexdigest()))
                    ids_digest, bytes_digest, many = hashlib.sha256(), hashlib.sha256(), 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return of


def _joined(lists: pa.ListArray) -> list[tuple[int, bytes]]:
    """Number of ids and their decimal text, joined by commas."""
    texts = pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string()))
    joined = pa.compute.binary_join(texts, ",")
    return [(n, t.encode()) for n, t in zip(pa.compute.list_value_length(lists).to_pylist(), joined.to_pylist(), strict=True)]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them: rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each row of `docs`.

    What `encode` and `decode` do, without sending ids through the plan. Ids are written in decimal and joined by commas.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_round_trip(shared(docs.sparkSession, vocabulary)), DIGESTS)
