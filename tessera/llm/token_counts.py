"""Token counts by a compiled finite-state transducer.

The tokenizer file (a BPE piece model with byte fallback) is compiled, lazily, into a deterministic transducer over
characters. In an encoding by merges, every prefix of a text has exactly one last token: the token t such that the token
before it and t are left unmerged when the two are encoded together. A state holds, for each place before the present one
where a piece may still start, the piece prefix read since, the last token of the encoding up to there, and by how much that
encoding's count differs from the present one. Reading a character extends the prefixes; the one that is now a piece and
follows its last token unmerged is the new last token, and the change of the count is annotated on the transition. No piece
spans the start of a word or a character outside the vocabulary, so there the state falls back to a few reset states.

A batch's texts are one stream of character classes, cut into equal chunks that are run in lockstep. The state map of a chunk
(entry state to exit state and count) is first taken at one entry state, that which a short run over the characters before the
chunk leads to: tokens are local, so it is nearly always the true one. A scan composes the maps: where a chunk's exit state is
not the entry state at which the next one's map is known, the next chunk is read from there too, in lockstep with all others
like it, until it comes to a state that it had at that place before; from there on the two readings are the same. The scan is
repeated until every map is known where it is entered, which makes the counts exact whatever the guesses were. Nothing
depends on spaces. Transitions that are met for the first time are compiled then; table, states and what they refer to are
dropped together beyond a bounded size, of which the state that a chunk was in is carried over.

Null and empty texts have no tokens; repeated rows are counted each; an empty table gives no rows. Very long texts are read in
pieces of the same stream. Begin, end and added tokens are not counted; special strings inside texts are ordinary text. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

FILE = "piece_bpe_32k.model"
#: Tokens beyond which a document is over the limit.
LIMIT = 4096
#: Classes and chunks of a piece of the stream, the characters read before a chunk to guess its entry state.
PIECE = 1 << 19
CHUNK = 256
BEFORE = 24
#: States, and pages of the table, beyond which it starts anew before the next piece; entries of a page.
MAX_STATES = 1 << 17
MAX_PAGES = 1 << 18
PAGE = 32
MAX_PAIRS = 600_000
#: Below a trie node with up to so many pieces, last tokens are told apart only by which of these may follow.
FEW_PIECES = 24

_SPACE = 0x2581
#: Classes 0 to 5: the end of a text, a space, and characters by how many tokens they always are, whatever is around them:
#: those that are in no longer piece (1), and those outside the vocabulary by their UTF-8 bytes (1 to 4).
_END, _WORD, _OUT = 0, 1, 2


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        pieces = {self.lib.id_to_piece(i): i for i in plain}
        self.trie: list[dict[int, int]] = [{}]
        self.piece_at: list[int] = [-1]
        for p, i in pieces.items():
            node = 0
            for c in p:
                if ord(c) not in self.trie[node]:
                    self.trie[node][ord(c)] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(-1)
                node = self.trie[node][ord(c)]
            self.piece_at[node] = i
        self.text_of = {i: p for p, i in pieces.items()}
        #: What the compiled form relies on; where it doesn't hold, the library reads the texts.
        mixed = any(a != chr(_SPACE) and b == chr(_SPACE) for p in pieces for a, b in zip(p, p[1:], strict=False))
        singles = {p for p in pieces if len(p) == 1}
        self.sound = not mixed and all(c in singles for p in pieces for c in p) and self.lib.encode("\n")[-1:] == [self.lib.piece_to_id("<0x0A>")] and self.lib.encode(" a b", out_type=str) == self.lib.encode("▁a▁b", out_type=str) and not any(self.lib.id_to_piece(i) in pieces for i in range(n) if self.lib.is_byte(i))
        inside = {c for p in pieces if len(p) > 1 for c in p}
        self.known = {ord(c) for c in singles if c in inside}
        self.lone = {ord(c) for c in singles if c not in inside}
        #: Characters that something follows in a piece; nothing merges with a token that ends otherwise.
        self.joins = {c for p in pieces for c in p[:-1]}
        self.follows: dict[int, bool] = {}
        self.below: dict[int, tuple[int, ...] | None] = {}
        self.classes: dict[int, int] = {}
        self.char_class = np.full(0x110000, -1, dtype=np.int16)
        self.char_class[ord(" ")] = self.char_class[_SPACE] = _WORD
        self.chars: list[int] = [0, _SPACE, 0, 0, 0, 0]
        self.pages_each = -(-(len(self.known) + len(self.chars)) // PAGE)
        self.clear()

    # States: tuples of (trie node, what may follow there, the count at its start less the present one), the nearest start
    # last. What may follow: a last token (0 or more), anything (-1), or one of the interned sets of pieces (-2 and below):
    # where few pieces lie below a node, only which of them the last token leaves unmerged matters, and many last tokens
    # are alike in that. The table has a row of pages for each state; a page holds the transitions of PAGE classes and is made
    # when one of them is met. An entry holds the next state's row and, in the low six bits, the emitted count plus 32.
    def clear(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.forms: dict[tuple[int, int], int | None] = {}
        self.sets: list[frozenset[int]] = []
        self.set_ids: dict[tuple[int, ...], int] = {}
        self.rows = np.zeros(256 * self.pages_each, dtype=np.int64)  # places in the table; page 0 is of unknown ones
        self.table = np.full(1024 * PAGE, -1, dtype=np.int64)
        self.n_pages = 1
        self.start = self._state(((0, -1, 0),))
        self.word = self._state(self._read(((0, -1, 0),), _SPACE)[0])

    def full(self) -> bool:
        return len(self.states) > MAX_STATES or self.n_pages > MAX_PAGES

    def carried(self, s: int) -> int:
        """Clears, and gives the state that s was."""
        state = [(node, self.sets[-2 - key] if key < -1 else key, less) for node, key, less in self.states[s]]
        self.clear()
        return self._state(tuple((node, self._set(tuple(sorted(key))) if isinstance(key, frozenset) else key, less) for node, key, less in state))

    def _put(self, s: int, k: int, to: int, n: int) -> None:
        at = s * self.pages_each + k // PAGE
        if not self.rows[at]:
            if (self.n_pages + 1) * PAGE > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.rows[at] = self.n_pages * PAGE
            self.n_pages += 1
        self.table[self.rows[at] + k % PAGE] = to * self.pages_each * 64 + n + 32

    def _state(self, state: tuple) -> int:
        if (s := self.index.get(state)) is None:
            s = self.index[state] = len(self.states)
            self.states.append(state)
            if (s + 1) * self.pages_each > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        return s

    def _set(self, ok: tuple[int, ...]) -> int:
        if (got := self.set_ids.get(ok)) is None:
            got = self.set_ids[ok] = -2 - len(self.sets)
            self.sets.append(frozenset(ok))
        return got

    def _unmerged(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when encoded together."""
        if (ok := self.follows.get(a << 32 | b)) is None:
            left = self.text_of[a] if a >= 0 else ""
            ok = self.lib.encode("\n" + left + self.text_of[b])[2:] == ([a, b] if a >= 0 else [b])
            if len(self.follows) > MAX_PAIRS:
                self.follows.clear()
            self.follows[a << 32 | b] = ok
        return ok

    def _below(self, node: int) -> tuple[int, ...] | None:
        """The pieces strictly below a trie node, if they are few."""
        if node not in self.below:
            found, todo = [], list(self.trie[node].values())
            while todo and len(found) <= FEW_PIECES:
                at = todo.pop()
                if self.piece_at[at] >= 0:
                    found.append(self.piece_at[at])
                todo += self.trie[at].values()
            self.below[node] = None if todo or len(found) > FEW_PIECES else tuple(sorted(found))
        return self.below[node]

    def _may(self, node: int, key: int) -> int | None:
        """What may follow at a node, in its least form; None if nothing may."""
        if key == -1 and self.trie[node]:
            return key
        got = self.forms.get((node, key), 0)
        if got == 0:
            few = self._below(node)
            if few is None:
                got = key
            else:
                ok = tuple(p for p in few if (self._unmerged(key, p) if key >= 0 else key == -1 or p in self.sets[-2 - key]))
                got = self._set(ok) if ok else None
            self.forms[node, key] = got
        return got

    def _read(self, state: tuple, c: int) -> tuple[tuple, int]:
        live, token, count = [], -1, 0
        for node, key, less in state:
            to = self.trie[node].get(c)
            if to is None:
                continue
            p = self.piece_at[to]
            if token < 0 and p >= 0 and (p in self.sets[-2 - key] if key < -1 else self._unmerged(key, p)):
                token, count = p, less + 1
            if self.trie[to] and (form := self._may(to, key)) is not None:
                live.append((to, form, less))
        if token < 0:
            raise ValueError(f"no token ends at character {c}")
        if self.text_of[token][-1] not in self.joins:
            token = -1
        return (*((node, key, less - count) for node, key, less in live), (0, token, 0)), count

    def compile(self, s: int, k: int) -> None:
        """The transition from state s at class k."""
        state = self.states[s]
        if k == _END:
            self._put(s, k, self.start, 0)
        elif _OUT <= k < _OUT + 4:
            self._put(s, k, self.start, k - _OUT + 1)
        elif k == _WORD and not self._in_spaces(state):
            self._put(s, k, self.word, 1)
        else:
            target, n = self._read(state, self.chars[k])
            if not -32 <= n < 32:
                raise ValueError(f"a count changes by {n}")
            self._put(s, k, self._state(target), n)

    def _in_spaces(self, state: tuple) -> bool:
        """Whether the last token is of spaces only, or there is none: then a space doesn't start a word."""
        last = state[-1][1]
        return last >= 0 and set(self.text_of[last]) == {chr(_SPACE)}

    def class_of(self, chars: np.ndarray) -> np.ndarray:
        """Classes of code points."""
        got = self.char_class[chars]
        if (got < 0).any():
            for c in np.unique(chars[got < 0]).tolist():
                if c in self.known:
                    self.char_class[c] = len(self.chars)
                    self.chars.append(c)
                else:
                    self.char_class[c] = _OUT if c in self.lone else _OUT + len(chr(c).encode("utf-8", "surrogatepass")) - 1
            got = self.char_class[chars]
        return got

    def _step(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The table's entries at rows (states times their pages) and classes; unknown ones are compiled."""
        got = self.table.take(self.rows.take(rows + k // PAGE) + k % PAGE)
        if got.min(initial=0) < 0:
            miss = got < 0
            for s, c in set(zip((rows[miss] // self.pages_each).tolist(), k[miss].tolist(), strict=True)):
                self.compile(s, c)
            got = self.table.take(self.rows.take(rows + k // PAGE) + k % PAGE)
        return got

    def _guesses(self, stream: np.ndarray, entry: int) -> np.ndarray:
        """Rows of the entry states of chunks: what comes of the characters before each, from the last of them after which the
        state is the same whatever came before, if there is one."""
        before = stream[-BEFORE - 1 :, :-1]
        anew = (before == _END) | (before >= _OUT) & (before < _OUT + 4)
        word = before == _WORD
        word[1:] &= ~word[:-1]
        word[0] = False
        reset = anew | word
        n = len(before)
        last = np.where(reset.any(axis=0), n - 1 - np.argmax(reset[::-1], axis=0), -1)
        at_word = (last >= 0) & word[last, np.arange(len(last))]
        row = np.where(at_word, self.word, self.start) * self.pages_each
        for t in range(n):
            some = np.flatnonzero(last < t)
            row[some] = self._step(row[some], before[t, some]) >> 6
        return np.concatenate([[entry * self.pages_each], row])

    def read(self, got: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Emitted counts of a piece of the stream, which is entered in a state, and the state after it."""
        m, lanes = min(CHUNK, len(got)), -(-len(got) // CHUNK)
        stream = np.zeros(lanes * m, dtype=np.int64)  # padded by ends of texts, which emit nothing
        stream[: len(got)] = got
        stream = np.ascontiguousarray(stream.reshape(lanes, m).T)
        entries = self._guesses(stream, entry)
        # the maps there, and the states on the way
        emitted, trail = np.zeros((m, lanes), dtype=np.int8), np.zeros((m, lanes), dtype=np.int64)
        row = entries
        for t in range(m):
            step = self._step(row, stream[t])
            emitted[t] = (step & 63) - 32
            row = trail[t] = step >> 6
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = None
        rounds = 0
        while len(wrong := np.flatnonzero(trail[-1, :-1] != entries[1:]) + 1):  # the scan
            if (rounds := rounds + 1) > 2:  # not local, as in long runs of a character: equal chunks share their maps
                if known is None:
                    same = np.unique(np.ascontiguousarray(stream.T).view(f"V{8 * m}"), return_inverse=True)[1].ravel().tolist()
                    known = {}
                    wrong = np.arange(lanes)
                for j in wrong.tolist():
                    known.setdefault((same[j], int(entries[j])), (emitted[:, j].copy(), trail[:, j].copy()))
                for j in range(1, lanes):
                    if (need := int(trail[-1, j - 1])) != entries[j]:
                        if (found := known.get((same[j], need))) is None:
                            break
                        entries[j], (emitted[:, j], trail[:, j]) = need, found
                wrong = np.flatnonzero(trail[-1, :-1] != entries[1:]) + 1
            entries[wrong] = row = trail[-1, wrong - 1]
            for t in range(m):
                if not len(wrong):
                    break
                step = self._step(row, stream[t, wrong])
                emitted[t, wrong] = (step & 63) - 32
                row = step >> 6
                other = row != trail[t, wrong]
                trail[t, wrong] = row
                wrong, row = wrong[other], row[other]
        last = (len(got) - 1) % m
        return emitted.T.ravel()[: len(got)], int(trail[last, -1]) // self.pages_each

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not self.sound:
            return np.array([len(x) for x in self.lib.encode(texts, num_threads=1)], dtype=np.int64)
        joined = "".join(" " + t + "\0" if t else "\0" for t in texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 2 if t else 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        total, state, before = [np.zeros(1, dtype=np.int64)], self.start, 0
        for s in range(0, len(chars), PIECE):
            if self.full():
                state = self.carried(state)
            got = self.class_of(chars[s : s + PIECE])
            here = ends[np.searchsorted(ends, s) : np.searchsorted(ends, s + PIECE)] - s
            got[here] = _END
            emitted, state = self.read(got, state)
            so_far = np.cumsum(emitted, dtype=np.int64) + before
            before = int(so_far[-1])
            total.append(so_far[here])
        return np.diff(np.concatenate(total))


_workers: dict[str, Transducer] = {}


def transducer(file: str) -> Transducer:
    import public_tokenizers

    if file not in _workers:
        _workers[file] = Transducer(public_tokenizers.path(file))
    return _workers[file]


def _count(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out, i = np.zeros(len(texts), dtype=np.int64), 0
            while i < len(texts):  # some texts at once
                j, chars = i, 0
                while j < len(texts) and chars < 2 * PIECE:
                    chars += len(texts[j])
                    j += 1
                out[i:j] = own.counts(texts[i:j])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, file: str = FILE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs, which is never moved."""
    src = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return src.mapInArrow(_count(file), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"))
