"""Exact, fast front ends to two public tokenizer libraries.

Both cut a text at blanks where no token can reach across, let the library
encode every distinct chunk once, and put the chunks' results together. A text
for which the cut isn't proven safe goes to the library whole.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that one worker remembers (about 200 bytes each).
CACHE_ENTRIES = 600_000
#: Chunks longer than this are encoded but not remembered.
CACHE_CHARS = 64
#: A full memory is emptied after so many chunks, as a multiple of its size, had to be encoded beside it.
STALE = 4
#: Words that the library gets as one text.
TOGETHER = 1024
#: Chunks put together at once.
STEP = 1 << 18
LINE = ".\n"
#: What often follows a word inside a chunk, and its run.
ENDED = {".": 1, ",": 2, LINE: 3}
#: Words and chunks that a worker remembers of a byte-level model (about 160 bytes each).
WORDS = 500_000
#: Below it, Python and the library agree about what a letter is.
LATIN_END = "\u0250"
#: What stands for U+0020 in the pieces of a sentencepiece model.
BLANK = "▁"


def model_path(model: str) -> str:
    """``model``: a path, or the name of a file of the public tokenizers package."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class Memory(dict):
    """Chunk to result, of bounded size."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries, self.beside, self.extra = encode, entries, 0, []

    def learn(self, chunks: set[str]) -> None:
        """From now until forget(), all of these chunks can be looked up."""
        if self.beside > STALE * self.entries:
            self.clear()
            self.beside = 0
        new = [x for x in chunks if x not in self]
        room = self.entries - len(self)
        self.update(zip(new, self.encode(new), strict=True))
        self.extra = new[room:] if room > 0 else new
        self.extra += [x for x in new[: max(0, room)] if len(x) > CACHE_CHARS]
        self.beside += len(self.extra)

    def forget(self) -> None:
        for x in self.extra:
            del self[x]
        self.extra = []


class Runs:
    """Runs of ids by number; run 0 is empty."""

    def __init__(self):
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def keep(self, n: int) -> None:
        """The first ``n`` alone."""
        self.ends = self.ends[: n + 1]
        self.ids = self.ids[: self.ends[-1]]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These runs' ids, one run after the other, and the runs' lengths."""
        starts = self.ends[numbers]
        lengths = self.ends[numbers + 1] - starts
        shift = starts - np.cumsum(lengths) + lengths
        return self.ids[np.arange(lengths.sum()) + np.repeat(shift, lengths)], lengths


class ByteBpe:
    """Ids of a byte-level BPE file as the tokenizers library gives them, special tokens not added.

    The byte-level pre-tokenizer starts a new pre-token at every single blank that
    stands between two characters that aren't white space, whatever surrounds it,
    and merges never leave a pre-token; so the chunks between such blanks encode
    alone. Texts that hold an added token's string, or a blank beside other white
    space, are encoded whole.

    A column is cut and its chunks are numbered by Arrow; each distinct chunk is
    looked up once. The library encodes the new words (many in one text, since each
    is a pre-token), and ids are put together by number.
    """

    def __init__(self, model: str, entries: int = WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_path(model))
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # what is remembered here stands before it
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        #: Whether an id's string starts with the byte-level letter of U+0020.
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        for name, i in self.library.get_vocab().items():
            self.opens[i] = name.startswith("\u0120")
        self.entries, self.beside = entries, 0
        self.line = self.whole(["\n"])[0][0]
        self._start()

    def _start(self) -> None:
        self.runs = Runs()
        for x in ENDED:
            own = self.whole([x])[0]
            self.runs.add(own, [len(own)])
        #: Numbers of runs: of words, and of other chunks, with a blank before them and without.
        self.later: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.later_others: dict[str, int] = {}
        self.first_others: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, int], blank: str, words: list[str]) -> None:
        """``words``: letters, each a pre-token. New runs, numbered in ``known``."""
        found, sizes = [], []
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            # In one text, a word starts where an id opens with a blank, or after each line end.
            ids = self.whole([blank + (blank or "\n").join(own)])[0]
            if blank:
                starts = np.flatnonzero(self.opens[ids])
                lengths = np.diff(starts, append=len(ids))
            else:
                cuts = np.flatnonzero(ids == self.line)
                lengths = np.diff(cuts, prepend=-1, append=len(ids)) - 1
                ids = np.delete(ids, cuts)
            if len(lengths) != len(own):
                raise ValueError("words were not cut as expected")
            found.append(ids)
            sizes.append(lengths)
        if words:
            known.update(zip(words, range(len(self.runs), len(self.runs) + len(words)), strict=True))
            self.runs.add(np.concatenate(found), np.concatenate(sizes))

    def _numbers(self, chunks: list[str], blank: str) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct chunk three numbers of runs, and whether its text can't be cut there."""
        known, others = (self.later, self.later_others) if blank else (self.first, self.first_others)
        word_of, start_of = known.get, self.first.get
        head = list(map(word_of, chunks))
        out, bad = np.zeros((len(chunks), 3), np.int64), np.zeros(len(chunks), bool)
        ended: list[tuple[int, int, int]] = []
        rest, parsed = [], []
        for k in [k for k, x in enumerate(head) if x is None]:
            x = chunks[k]
            end = ENDED.get(x[-1:])
            if end:
                if (n := word_of(x[:-1])) is not None:
                    head[k] = n
                    ended.append((k, end, 0))
                    continue
            elif LINE in x:
                word, _, start = x.partition(LINE)
                if (n := word_of(word)) is not None and (m := start_of(start)) is not None:
                    head[k] = n
                    ended.append((k, ENDED[LINE], m))
                    continue
            if (n := others.get(x)) is not None:
                head[k] = n
            else:
                rest.append(k)
        words, starts, more = {}, {}, {}
        for k in rest:
            x = chunks[k]
            if x.isalpha() and max(x) < LATIN_END:
                word, end, start = x, 0, None
            elif not x or x[0].isspace() or x[-1].isspace():
                bad[k], head[k] = True, 0
                continue
            else:
                word, end, start = x[:-1], ENDED.get(x[-1], 0), None
                if LINE in x:
                    word, _, start = x.partition(LINE)
                    end = ENDED[LINE]
                if max(x) >= LATIN_END or not end or not word.isalpha() or not (start is None or start.isalpha()):
                    more[x] = None
                    parsed.append((k, x, 0, None))
                    continue
            words[word] = None
            if start is not None:
                starts[start] = None
            parsed.append((k, word, end, start))
        if not blank:
            words |= starts
            starts = {}
        self._learn(known, blank, [x for x in words if x not in known])
        self._learn(self.first, "", [x for x in starts if x not in self.first])
        if more:
            found = self.whole([blank + x for x in more])
            others.update(zip(more, range(len(self.runs), len(self.runs) + len(more)), strict=True))
            self.runs.add(np.concatenate(found), [len(x) for x in found])
        for k, word, end, start in parsed:
            head[k] = known[word] if end or word in known else others[word]
            if end:
                ended.append((k, end, self.first[start] if start else 0))
        out[:, 0] = head
        if ended:
            at, end, start = zip(*ended, strict=True)
            out[at, 1], out[at, 2] = end, start
        return out, bad

    def _forget(self) -> None:
        """What is over the memory's size goes; so does all, once much had to be encoded beside it."""
        n = self.entries + 1 + len(ENDED)
        if len(self.runs) <= n:
            return
        self.beside += len(self.runs) - n
        if self.beside > STALE * self.entries:
            self.beside = 0
            self._start()
            return
        self.runs.keep(n)
        for known in (self.later, self.first, self.later_others, self.first_others):
            while known:  # numbers only grow, so the newest go
                x, number = known.popitem()
                if number < n:
                    known[x] = number
                    break

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other (null: none), and where each text's begin and end."""
        collects = gc.isenabled()
        gc.disable()  # nothing made here is cyclic, and the memory is large to walk
        try:
            return self._encode(column)
        finally:
            if collects:
                gc.enable()

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        column = column.fill_null("")
        parts = pc.split_pattern(column, " ")
        cuts = parts.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        coded = parts.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        starts = cuts[:-1]
        later = np.ones(len(at), bool)
        later[starts] = False
        used = np.zeros(len(chunks), bool)
        used[at[later]] = True
        begins, which = np.unique(at[starts], return_inverse=True)
        numbers, bad = self._numbers(chunks[used].tolist(), " ")
        heads, no = self._numbers(chunks[begins].tolist(), "")
        no &= chunks[begins] != ""  # a text may begin with its only blank
        place = np.zeros(len(chunks), np.int64)
        place[used] = np.arange(used.sum())
        at = place[at]
        at[starts] = len(numbers) + which
        bad = np.concatenate([bad, no])

        whole = np.zeros(len(column), bool)
        for x in self.added:
            whole |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        if bad.any():
            whole |= np.logical_or.reduceat(bad[at], starts)
        ids, lengths = self.runs.take(np.concatenate([numbers, heads]).ravel())
        own = Runs()
        own.add(ids, lengths.reshape(-1, 3).sum(axis=1))
        self._forget()
        at += 1
        if whole.any():
            at[np.repeat(whole, np.diff(cuts))] = 0
        found = [own.take(at[i : i + STEP]) for i in range(0, len(at), STEP)]
        ids = np.concatenate([x for x, _ in found])
        sizes = np.add.reduceat(np.concatenate([x for _, x in found]), starts)
        if whole.any():
            at = np.flatnonzero(whole)
            more = self.whole(column.take(pa.array(at)).to_pylist())
            before = np.concatenate([[0], np.cumsum(sizes)])[at]
            pieces = [y for x, (a, b) in zip(more, zip(before, [*before[1:], len(ids)], strict=True), strict=True) for y in (x, ids[a:b])]
            ids = np.concatenate([ids[: before[0]], *pieces])
            sizes[at] = [len(x) for x in more]
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        ids, cuts = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_column, with ``end_id`` after each text."""
        ids, cuts = self.encode_column(column)
        ends = cuts + np.arange(len(cuts))
        out = np.full(len(ids) + len(column), end_id, "<u4")
        body = np.ones(len(out), bool)
        body[ends[1:] - 1] = False
        out[body] = ids
        return out, ends


class PieceCounter:
    """Token counts of a sentencepiece model whose pieces hold its blank sign at the start only.

    Offline proof: every vocabulary string is encoded alone; those that give
    exactly their own id make ``single``. A pre-token (a blank and what follows up
    to the next) found there counts one; the others are merged by the library. A
    text with blanks in a row, at its start, or with the blank sign itself is
    encoded whole.
    """

    def __init__(self, model: str, entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        pieces = self.library.id_to_piece(list(range(self.library.get_piece_size())))
        #: Whether no piece reaches over a blank that follows something else.
        self.cuts = not any(BLANK in x.lstrip(BLANK) for x in pieces)
        named = [(i, x[1:]) for i, x in enumerate(pieces) if x[:1] == BLANK and x[1:] and BLANK not in x[1:]]
        alone = self.library.encode([x for _, x in named], num_threads=1)
        self.single = {x: 1 for (i, x), ids in zip(named, alone, strict=True) if ids == [i]}
        self.memory = Memory(self._merged, entries)
        self.memory.update(self.single)
        self.memory.entries += len(self.single)

    def _merged(self, chunks: list[str]) -> list[int]:
        return list(map(len, self.library.encode(chunks, num_threads=1)))

    def count(self, texts: list[str]) -> list[int]:
        out, rest, cut, whole = [0] * len(texts), set(), [], []
        for i, text in enumerate(texts):
            if not self.cuts or "  " in text or text[:1] == " " or BLANK in text:
                whole.append(i)
            elif text:
                chunks = text.split(" ")
                cut.append((i, chunks))
                rest.update(chunks)
        ends = "" in rest  # a text's last blank is a token by itself
        rest.discard("")
        known = self.memory
        known.learn(rest)
        for i, chunks in cut:
            if ends and not chunks[-1]:
                out[i] = 1
                chunks.pop()
            out[i] += sum([known[x] for x in chunks])
        known.forget()
        for i, n in zip(whole, self._merged([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


_BYTE_BPE: dict[tuple[str, int], ByteBpe] = {}
_PIECES: dict[str, PieceCounter] = {}


def byte_bpe(model: str, entries: int = WORDS) -> ByteBpe:
    """One per worker process, kept between tasks. ``entries``: words it remembers."""
    if (model, entries) not in _BYTE_BPE:
        _BYTE_BPE[model, entries] = ByteBpe(model, entries)
    return _BYTE_BPE[model, entries]


def piece_counter(model: str) -> PieceCounter:
    """One per worker process, kept between tasks."""
    if model not in _PIECES:
        _PIECES[model] = PieceCounter(model)
    return _PIECES[model]
