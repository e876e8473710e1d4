"""Byte-level BPE: DuckDB recursive queries in each partition contract the words, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import read, small_batches

#: Words whose tokens a worker remembers, and texts (characters, and ROW for each row) that it encodes at a time.
REMEMBERED, CHUNK_BYTES, ROW = 1_000_000, 8 << 20, 64
#: Token positions that go through the recursion at a time, and the rounds of so many before only the last one's rows
#: go on (of fewer positions as many more, up to MOST_ROUNDS, for the same memory).
PIECE, ROUNDS, MOST_ROUNDS = 1 << 20, 8, 32
#: White space other than single spaces between other signs and what stands inside a cut.
_GAP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_ODD = f"^{_GAP}|{_GAP}$| {_GAP}|{_GAP} "

#: Token positions k with their block b (word << 32 | number) and token. A round joins each token and the next one with
#: the merge table and contracts, at once, every pair that the one-by-one order (least rank, then leftmost) would come to
#: as it stands now: nothing in its own block or a neighbouring one has a lower rank. A block is at least twice as long as
#: the longest token that its bytes can make, so what happens further off can't grow a token up to the pair first. Short
#: words are one block (number 0), so for them it is the word's least rank. Of pairs with one rank that overlap, every
#: second one goes, from the left end of the chain, which waits while the pair before it has that rank but can't go yet.
#: Where a pair's token can make a pair of a still lower rank, those of its rank right of it near by wait for it.
#: Words without a pair are done: they have no rows in later rounds.
ENCODE = """
WITH RECURSIVE step(k, b, tok, round) AS (
  SELECT k, b, tok, 0 FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT *, lead(tok) OVER o AS nxt, lead(k) OVER o AS next, lead(b) OVER o AS nb FROM step WHERE round < $rounds WINDOW o AS (ORDER BY k)
   ), paired AS MATERIALIZED (
     SELECT p.k, p.b, p.next, m.rank, m.safe FROM p JOIN merge m ON m.l = p.tok AND m.r = p.nxt WHERE p.nb <= p.b + 1
   ), least AS MATERIALIZED (
     SELECT b, min(rank) AS rank FROM paired GROUP BY b
   ), near AS (
     SELECT b, rank FROM least WHERE b & 4294967295 = 0
     UNION ALL SELECT b + d.d, min(rank) FROM least, (VALUES (-1), (0), (1)) d(d) WHERE b & 4294967295 <> 0 GROUP BY ALL
   ), first AS MATERIALIZED (
     SELECT p.* FROM paired p JOIN near n ON n.b = p.b AND n.rank = p.rank WHERE p.b NOT IN (SELECT b FROM frozen)
   ), harm AS MATERIALIZED (
     SELECT f.b, f.rank, min(f.k) AS k FROM (SELECT f.*, after.tok AS after FROM first f JOIN p n ON n.k = f.next LEFT JOIN p after ON after.k = n.next WHERE NOT f.safe) f LEFT JOIN p before ON before.next = f.k
     WHERE EXISTS (FROM merge m WHERE m.l = before.tok AND m.r = f.rank AND m.rank < f.rank) OR EXISTS (FROM merge m WHERE m.l = f.rank AND m.r = f.after AND m.rank < f.rank)
       OR EXISTS (FROM merge m WHERE m.l = f.rank AND m.r = f.rank AND m.rank < f.rank) GROUP BY f.b, f.rank
     UNION ALL SELECT b, rank, min(k) FROM paired WHERE NOT safe AND b & 4294967295 <> 0 AND k NOT IN (SELECT k FROM first) GROUP BY b, rank
   ), calm AS (
     SELECT f.k, f.next, f.b, f.rank FROM first f LEFT JOIN (SELECT b + d.d AS b, rank, min(k) AS k FROM harm, (VALUES (-1), (0), (1)) d(d) GROUP BY ALL) h ON h.b = f.b AND h.rank = f.rank WHERE h.k IS NULL OR f.k <= h.k
   ), chained AS MATERIALIZED (
     SELECT *, row_number() OVER o AS nth, coalesce(lag(next) OVER o = k AND lag(b) OVER o >= b - 1, false) AS goes_on FROM calm WINDOW o AS (ORDER BY k)
   ), waiting AS (
     SELECT c.nth AS head FROM chained c JOIN paired q ON q.next = c.k AND q.rank = c.rank WHERE NOT c.goes_on
   ), hit AS MATERIALIZED (
     SELECT k, b, next, rank FROM (SELECT *, max(CASE WHEN NOT goes_on THEN nth END) OVER (ORDER BY nth) AS head FROM chained) WHERE (nth - head) % 2 = 0 AND head NOT IN (SELECT head FROM waiting)
   )
   SELECT p.k, p.b, coalesce(a.rank, p.tok), round + 1 FROM p LEFT JOIN (SELECT k, rank FROM hit UNION ALL SELECT next, -1 FROM hit) a ON a.k = p.k WHERE p.b >> 32 IN (SELECT b >> 32 FROM hit) AND a.rank IS DISTINCT FROM -1
  )
)
SELECT k, b, tok, step.round AS round FROM step JOIN (SELECT b >> 32 AS w, max(round) AS round FROM step GROUP BY w) l ON l.w = b >> 32 AND l.round = step.round ORDER BY k
"""
#: The same for words of at most SHORT bytes, a list of tokens for each word w: the one-by-one order itself, a pair of
#: each word in a round, until no word has one.
SHORT = 32
ENCODE_SHORT = """
WITH RECURSIVE step(w, toks, done) AS (
  SELECT w, toks, false FROM start
  UNION ALL
  (WITH held AS MATERIALIZED (
     SELECT w, toks FROM step WHERE NOT done
   ), pair AS (
     SELECT w, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i FROM held
   ), hit AS (
     SELECT p.w, min(m.rank::BIGINT << 32 | p.i) AS best FROM pair p JOIN merge m ON m.l = p.l AND m.r = p.r GROUP BY p.w
   )
   SELECT s.w, CASE WHEN best IS NULL THEN toks ELSE toks[:(best & 4294967295) - 1] || [(best >> 32)::INTEGER] || toks[(best & 4294967295) + 2:] END, best IS NULL
   FROM held s LEFT JOIN hit h ON h.w = s.w
  )
)
SELECT w, toks FROM step WHERE done ORDER BY w
"""
#: Words that are decoded as one.
GROUP = 256
DECODE = "SELECT d, array_to_string(list(v.chars ORDER BY pos), '') AS chars FROM tokens JOIN vocabulary v USING (tok) GROUP BY d ORDER BY d"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """l, r, rank, safe: each way to cut a token in two. safe: no token of a lower rank starts or ends with it."""
    lower: set[bytes] = set()
    rows = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = token[:i], token[i:]
            ra, rb = ranks.get(a), ranks.get(b)
            if ra is not None and ra > rank:
                lower.add(a)
            if rb is not None and rb > rank:
                lower.add(b)
            if ra is not None and rb is not None:
                rows.append((ra, rb, rank))
    unsafe = {ranks[x] for x in lower}
    l, r, m = (pa.array([x[i] for x in rows], pa.int32()) for i in range(3))
    return pa.table({"l": l, "r": r, "rank": m, "safe": pa.array([x[2] not in unsafe for x in rows], pa.bool_())})


class Codec:
    """A DuckDB database in memory with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_spaces: bool = True):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merge = merge_table(ranks)  # noqa: F841
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merge AS SELECT * FROM merge")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        self.ranks, self.cut_at_spaces = ranks, cut_at_spaces
        self.longest = sorted(ranks, key=len, reverse=True)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words as little-endian unsigned 32-bit integers: a token by itself has its own id, as the
        tiktoken library has it; any other word, of whatever length, is contracted by a recursion."""
        held, size = ([], []), [0, 0]
        for word in words:
            raw = word.encode()
            if (one := self.ranks.get(raw)) is not None:
                self.known[word] = one.to_bytes(4, "little")
                continue
            short = len(raw) <= SHORT
            held[short].append((word, raw))
            size[short] += len(raw)
            if size[short] >= PIECE:
                (self._contract_short if short else self._contract)(held[short])
                held[short].clear()
                size[short] = 0
        for rows, contract in zip(held, (self._contract, self._contract_short)):
            if rows:
                contract(rows)

    def _contract_short(self, rows: list[tuple[str, bytes]]) -> None:
        ends = np.cumsum([0, *(len(raw) for _, raw in rows)]).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(raw for _, raw in rows), np.uint8)]
        self.db.register("start", pa.table({"w": np.arange(len(rows), dtype=np.int32), "toks": pa.ListArray.from_arrays(ends, tok)}))
        got = self.db.sql(ENCODE_SHORT).to_arrow_table().column("toks").combine_chunks()
        whole, at = got.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), 0
        for (word, _), n in zip(rows, pc.list_value_length(got).to_pylist()):
            self.known[word] = whole[at : at + 4 * n]
            at += 4 * n

    def _wide(self, raw: bytes) -> int:
        """Twice the length of the longest token that is made of bytes of raw: the size of a block."""
        own = bytes(set(raw))
        return 2 * next((len(t) for t in self.longest if not t.translate(None, own)), 1)

    def _contract(self, rows: list[tuple[str, bytes]]) -> None:
        size = np.array([len(raw) for _, raw in rows])
        alone = 2 * len(self.longest[0])
        wide = self._wide(b"".join(raw for _, raw in rows if len(raw) > alone)) if (size > max(alone, SHORT)).any() else alone
        w, k = np.repeat(np.arange(len(rows)), size), np.arange(size.sum())
        block = (k - np.repeat(np.cumsum(size) - size, size)) // wide + 1
        b = (w << 32) | np.where(np.repeat(size <= max(alone, SHORT), size), 0, block)
        tok = self.byte[np.frombuffer(b"".join(raw for _, raw in rows), np.uint8)]
        piece = max(PIECE, 16 * wide)  # so that what stays as it is at one piece's end lies inside a piece of the next turn
        done, turn, idle = [], 0, np.zeros(len(rows), np.int64)
        while len(k):
            some = min(MOST_ROUNDS, max(ROUNDS, ROUNDS * PIECE // len(k)))
            got, cut = self._turn(k, b, tok, piece, piece // 2 * (turn % 2), ENCODE.replace("$rounds", str(some)))
            turn += 1
            k, b, tok, rounds = (np.concatenate([g.column(c).to_numpy() for g in got]) for c in ("k", "b", "tok", "round"))
            most = np.zeros(len(rows), np.int64)
            np.maximum.at(most, b >> 32, rounds)
            idle = np.where(most > 0, 0, idle + 1)
            # a word that was cut is done when nothing was found in two turns, whose pieces end at different places
            open_ = np.where(np.isin(np.arange(len(rows)), cut), idle < 2, most == some)[b >> 32]
            done.append((k[~open_], b[~open_], tok[~open_]))
            k, b, tok = k[open_], b[open_], tok[open_]
        k, b, tok = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(k, kind="stable")
        whole, at = tok[order].astype("<u4").tobytes(), 0
        ends = np.cumsum(np.bincount(b >> 32, minlength=len(rows))) * 4
        for (word, _), end in zip(rows, ends.tolist()):
            self.known[word] = whole[at:end]
            at = end

    def _turn(self, k: np.ndarray, b: np.ndarray, tok: np.ndarray, piece: int, shift: int, query: str) -> tuple[list[pa.Table], list[int]]:
        """One run of the recursion over each piece of about `piece` positions, and the words that were cut.

        Pieces end where blocks do. In a word that goes on beyond its piece the blocks at that end stay as they are.
        """
        ends = np.arange(piece - shift, len(b), piece) if len(b) > 2 * piece else np.zeros(0, np.int64)
        ends = [0, *np.unique(np.searchsorted(b, b[ends])).tolist(), len(b)]
        out, cut = [], []
        for lo, hi in zip(ends, ends[1:]):
            if lo == hi:
                continue
            frozen = []
            if lo and b[lo - 1] >> 32 == b[lo] >> 32:
                frozen.append(int(b[lo]))
            if hi < len(b) and b[hi - 1] >> 32 == b[hi] >> 32:
                frozen += [int(b[hi - 1]), int(b[hi - 1]) - 1]
            cut += [x >> 32 for x in frozen]
            self.db.register("start", pa.table({"k": k[lo:hi].astype(np.int32), "b": b[lo:hi], "tok": tok[lo:hi].astype(np.int32)}))
            self.db.register("frozen", pa.table({"b": pa.array(frozen, pa.int64())}))
            out.append(self.db.sql(query).to_arrow_table())
        return out, cut

    def _words(self, heads: list[str], cuts: list[str]) -> tuple[list[str], np.ndarray]:
        """The matches of heads, then of cuts with a space before them, and where each one's begin."""
        parts = [self.split(h) for h in heads]
        found = self.split(" " + " ".join(cuts)) if cuts else []
        begins = np.flatnonzero(pc.starts_with(pa.array(found, pa.large_string()), " ").to_numpy(zero_copy_only=False))
        if len(begins) != len(cuts):  # the pattern leaves spaces out: nothing shows where a cut begins
            each = [self.split(" " + t) for t in cuts]
            found, begins = [w for words in each for w in words], np.cumsum([0, *map(len, each)])[:-1]
        first = np.cumsum([0, *map(len, parts)])
        return [w for words in parts for w in words] + found, np.concatenate([first[:-1], begins + first[-1]]).astype(np.int64)

    def _encode(self, texts: list[str], back: bool) -> list[pa.LargeBinaryArray]:
        """The ids of each text and, if asked for, what they decode to. Where no match of the pattern goes on over a single
        space between two signs that are no white space (cut_at_spaces), texts are cut there and each different cut is
        matched once; others are matched whole. Each different word's ids are looked up, and decoded, once; as both are
        the same wherever the word stands, cuts and texts are put together from them in order."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD).to_pylist() if self.cut_at_spaces else [True] * len(texts)
        heads, rests = zip(*((t, None) if o else t.partition(" ")[::2] for t, o in zip(texts, odd))) if texts else ((), ())
        cuts = pc.split_pattern(pa.array([r or None for r in rests], pa.large_string()), " ")
        coded = cuts.flatten().dictionary_encode()
        firsts = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        found, begins = self._words(list(firsts), coded.dictionary.to_pylist())
        n = np.nan_to_num(pc.list_value_length(cuts).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.cumsum(n) - n
        order = np.insert(coded.indices.to_numpy().astype(np.int64) + len(firsts), starts, [firsts[h] for h in heads])
        words = pa.array(found, pa.large_string()).dictionary_encode()
        different = words.dictionary.to_pylist()
        self.learn([w for w in different if w not in self.known])
        ids = pa.array(list(map(self.known.__getitem__, different)), pa.large_binary())
        lay = lambda x: _joined(_joined(x.take(words.indices), begins).take(pa.array(order)), starts + np.arange(len(n)))
        return [lay(ids), lay(self._decode(ids))] if back else [lay(ids)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._encode(texts, False)[0].to_pylist()

    def round_trip(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
        """The ids of each text and the bytes they decode to."""
        ids, back = self._encode(texts, True)
        return ids, back

    def _decode(self, ids: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """What each value's ids decode to; GROUP values are aggregated together and told apart by their tokens' lengths."""
        ends = _ends(ids) // 4
        tok = np.frombuffer(ids.buffers()[2] or b"", "<u4", ends[-1]).astype(np.int32)
        d = np.repeat(np.arange(len(ids), dtype=np.int32) // GROUP, np.diff(ends))
        self.db.register("tokens", pa.table({"d": d, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
        chars = self.db.sql(DECODE).to_arrow_table().column("chars").to_pylist()
        return _binary(np.cumsum(np.concatenate([[0], self.length[tok]]))[ends], pa.py_buffer("".join(chars).encode("latin-1")))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        return self._decode(pa.array(ids, pa.large_binary())).to_pylist()


def _binary(ends: np.ndarray, data: pa.Buffer | None) -> pa.LargeBinaryArray:
    ends = np.ascontiguousarray(ends, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


def _ends(x: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], np.int64, len(x) + 1) if len(x) else np.zeros(1, np.int64)


def _joined(x: pa.LargeBinaryArray, begins: np.ndarray) -> pa.LargeBinaryArray:
    """x with everything from one of begins up to the next as one value."""
    return _binary(_ends(x)[np.append(begins, len(x))], x.buffers()[2])


def _digests(x: pa.LargeBinaryArray) -> pa.Array:
    ends, data = _ends(x).tolist(), memoryview(x.buffers()[2])
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())


#: The codec that a Python worker made last: building one takes longer than many a task's texts.
_codec: dict[tuple[str, str, bool], Codec] = {}


def worker_codec(name: str, ranks, pattern: str, cut_at_spaces: bool) -> Codec:
    """The codec of a rank file by its digest; ranks: a broadcast of its table. Spark hands a worker one task after the
    other, so what earlier tasks remembered serves later ones, within REMEMBERED."""
    key = (name, pattern, cut_at_spaces)
    if key not in _codec:
        _codec.clear()
        _codec[key] = Codec(ranks.value, pattern, cut_at_spaces)
    return _codec[key]


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, cut_at_spaces: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text.

    ranks_file and pattern: a rank file of base64 tokens with one for each byte, and the pattern whose matches
    are encoded by themselves; the driver reads the file and sends it along. cut_at_spaces: whether no match of the
    pattern goes on over a single space in front of a sign, which saves matching words again. A null or empty text has no tokens.
    Texts and words of any length are encoded whole; of a word beyond PIECE bytes the recursion holds a piece at a time.
    Repeated rows and null doc_ids are answered like others; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    with open(ranks_file, "rb") as f:
        lines = f.read()
    name = hashlib.sha256(lines).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(lines))  # the vocabulary: of fixed size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skein.llm.bpe import worker_codec  # the worker's own module, which outlives the task

        codec = worker_codec(name, ranks, pattern, cut_at_spaces)

        def out(doc: list[int | None], text: list[str]) -> pa.RecordBatch:
            ids, back = codec.round_trip(text)
            cols = [pa.array(doc, pa.int64()), pa.array(np.diff(_ends(ids)) // 4), _digests(ids), _digests(back)]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        doc, text, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = t or ""
                if text and size + len(t) + ROW > CHUNK_BYTES:
                    yield out(doc, text)
                    doc, text, size = [], [], 0
                doc.append(i)
                text.append(t)
                size += len(t) + ROW
        if text:
            yield out(doc, text)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, kind)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
