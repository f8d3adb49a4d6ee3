"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A text gets a leading blank, blanks become the marker ``▁``, and the best-scoring sequence of pieces is found by dynamic
programming over all trie matches. Characters that no piece covers become byte pieces. Decoding joins pieces, turns byte
pieces back into UTF-8 and markers into blanks, and drops the leading one, so that any text comes back unchanged.

Where no piece holds a marker behind another character, no piece crosses the start of a word or a line, and the best path of a
text is the best paths of its words one after another. Words are then encoded once per worker and remembered (a bounded table);
otherwise the text is one word. Long words are encoded in time linear in their length.

Scores come from the model file if it is a unigram model. The pieces of a merge model carry merge ranks instead of log
probabilities; they get the log of Zipf's law by rank, ``-log(rank + 1)``. Nothing is trained. Scores are summed as whole
multiples of ``2 ** -24``, so that sums are exact; of equal paths the one whose last piece starts first is taken, at every place.

Cases: a null text has null ids and decodes to null; an empty text has no ids and decodes to the empty text; texts of any length are
whole; a marker character of the text itself is kept by byte pieces; ties between paths are settled above; repeated rows each get their
ids; an empty table gives no rows; other columns are kept, of whatever name, but for older ones of the results' names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARKER = "▁"
#: Words remembered in a task: those met last, and as many before them.
REMEMBERED = 1 << 16
#: A character that no piece covers scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Steps of a score.
SCALE = 1 << 24
#: Words up to this length are encoded many at once, longer ones one by one.
LONGEST_TOGETHER = 64
#: Bytes of text, and pieces, that are handled together; bounds memory, never a result.
BYTES_TOGETHER, PIECES_TOGETHER = 1 << 20, 1 << 18
#: Stands for a marker character in the text itself.
LITERAL = "\0" + MARKER
#: Private characters that stand for bytes while a text is decoded.
BYTE_AT = 0x10F000
BYTE_RUN = re.compile(f"[{chr(BYTE_AT)}-{chr(BYTE_AT + 255)}]+")


@dataclass
class DoubleArray:
    """Trie over code points: from state ``s`` by symbol ``c`` to ``base[s] + c`` if ``check`` there is ``s``."""

    symbols: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray

    @property
    def code_table(self) -> np.ndarray:
        """Symbol of each code point, 0 for those in no piece."""
        made = self.__dict__.get("_codes")
        if made is None:
            made = self.__dict__["_codes"] = np.zeros(max(map(ord, self.symbols), default=0) + 2, np.int64)
            for c, symbol in self.symbols.items():
                made[ord(c)] = symbol
        return made

    @classmethod
    def build(cls, pieces: list[tuple[str, int]]) -> DoubleArray:
        pieces = sorted(pieces)
        symbols = {c: i for i, c in enumerate(sorted({c for text, _ in pieces for c in text}), 1)}
        size = 4 * sum(len(t) for t, _ in pieces) + len(symbols) + 2
        base, check, piece = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free, todo = 1, [(0, 0, 0, len(pieces))]
        while todo:
            state, depth, lo, hi = todo.pop()
            if lo < hi and len(pieces[lo][0]) == depth:
                piece[state] = pieces[lo][1]
                lo += 1
            children = []
            while lo < hi:
                first, start = pieces[lo][0][depth], lo
                while lo < hi and pieces[lo][0][depth] == first:
                    lo += 1
                children.append((symbols[first], start, lo))
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            at = free
            while True:
                shift = at - children[0][0]
                if shift >= 0 and check[at] < 0:
                    need = shift + children[-1][0] + 1
                    if need > len(base):
                        grow = need - len(base) + size
                        base += [0] * grow
                        check += [-1] * grow
                        piece += [-1] * grow
                    if all(check[shift + c] < 0 for c, _, _ in children):
                        break
                at += 1
                if at >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    piece += [-1] * size
            base[state] = shift
            for c, start, end in children:
                check[shift + c] = state
                todo.append((shift + c, depth + 1, start, end))
        return cls(symbols, *(np.array(x, np.int64) for x in (base, check, piece)))


@dataclass
class UnigramModel:
    pieces: list[str]
    scores: list[int]
    lowest: int
    trie: DoubleArray
    bytes_of: dict[int, int]
    byte_ids: list[int]
    unknown: int
    control: set[int]
    words: re.Pattern | None
    #: Characters that are words of their own, where texts are cut into words.
    alone: str = ""
    #: Ids of words, blanks for markers, as 32-bit numbers.
    known: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)
    surface: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.surface = self.surfaces()

    def _viterbi(self, word: str) -> tuple[int, ...]:
        """Best path through one word, place by place."""
        symbols, base, check, piece, scores = self.trie.symbols, self.trie.base, self.trie.check, self.trie.piece, self.scores
        codes = [symbols.get(c, 0) for c in word]
        n, size = len(codes), len(check)
        best: list[float] = [-math.inf] * (n + 1)
        back, by = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for start in range(n):
            here, state, end, single = best[start], 0, start, False
            while end < n and (c := codes[end]):
                to = base[state] + c
                if to >= size or check[to] != state:
                    break
                state, end = int(to), end + 1
                if (p := int(piece[state])) >= 0:
                    single = single or end == start + 1
                    if (total := here + scores[p]) > best[end]:
                        best[end], back[end], by[end] = total, start, p
            if not single and (total := here + self.lowest) > best[start + 1]:
                best[start + 1], back[start + 1], by[start + 1] = total, start, -1
        path, end = [], n
        while end:
            path.append((by[end], back[end], end))
            end = back[end]
        return self._ids(word, reversed(path))

    def _ids(self, word: str, path: Iterable[tuple[int, int, int]]) -> tuple[int, ...]:
        ids: list[int] = []
        for p, start, end in path:
            if p >= 0:
                ids.append(p)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in word[start:end].encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def _viterbi_all(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        return (tuple(np.frombuffer(x, np.int32).tolist()) for x in self._all_paths(words))

    def _all_paths(self, words: list[str]) -> Iterator[bytes]:
        """The same for many short words at once: all trie walks step together, then all words fill their next place together."""
        base, check, piece, scores = self.trie.base, self.trie.check, self.trie.piece, np.asarray(self.scores)
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.trie.code_table[np.minimum(chars, len(self.trie.code_table) - 1)]
        last = np.cumsum(size + 1) - 1  # the place behind each word
        word_start = last - size
        offset = np.arange(len(chars)) - np.repeat(word_start, size + 1)
        starts, ends, pieces = [], [], []
        begin = np.delete(np.arange(len(chars)), last)
        state, at, origin = np.zeros(len(begin), np.int64), begin, begin
        covered = np.zeros(len(chars), bool)
        while len(origin):
            code = codes[at]
            to = base[state] + code
            ok = (code > 0) & (check[np.minimum(to, len(check) - 1)] == state) & (to < len(check))
            state, at, origin = to[ok], at[ok] + 1, origin[ok]
            found = piece[state] >= 0
            starts.append(origin[found])
            ends.append(at[found])
            pieces.append(piece[state[found]])
            covered[origin[found & (at == origin + 1)]] = True
        bare = begin[~covered[begin]]
        start, end = np.concatenate([*starts, bare]), np.concatenate([*ends, bare + 1])
        by = np.concatenate([*pieces, np.full(len(bare), -1)])
        gain = np.where(by >= 0, scores[by], self.lowest)
        order = np.lexsort((start, end, offset[end]))
        start, end, by, gain = start[order], end[order], by[order], gain[order]
        best, via = np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
        steps = np.searchsorted(offset[end], np.arange(1, size.max(initial=0) + 2))
        for lo, hi in zip(steps, steps[1:], strict=False):
            total, places = best[start[lo:hi]] + gain[lo:hi], end[lo:hi]
            first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            top = np.maximum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[first, hi - lo])))
            hit = hit[np.r_[True, places[hit][1:] != places[hit][:-1]]]  # of equal ones the earliest start
            best[places[hit]], via[places[hit]] = top, hit + lo
        out: list[tuple[np.ndarray, np.ndarray]] = []
        number, here = np.flatnonzero(size > 0), last[size > 0]
        while len(number):
            out.append((number, via[here]))
            here = start[via[here]]
            more = offset[here] > 0
            number, here = number[more], here[more]
        if not out:
            yield from (b"" for _ in words)
            return
        number, taken = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(number[::-1], kind="stable")
        number, taken = number[::-1][order], taken[::-1][order]
        cut = np.searchsorted(number, np.arange(len(words) + 1)).tolist()
        chosen, froms, tos = by[taken], (start[taken] - word_start[number]).tolist(), offset[end[taken]].tolist()
        odd = np.zeros(len(words), bool)
        odd[number[chosen < 0]] = True
        raw, chosen = chosen.astype(np.int32).tobytes(), chosen.tolist()
        for i, word in enumerate(words):
            lo, hi = cut[i], cut[i + 1]
            yield _bytes(self._ids(word, zip(chosen[lo:hi], froms[lo:hi], tos[lo:hi], strict=True))) if odd[i] else raw[4 * lo : 4 * hi]

    def _split(self, text: str) -> list[str]:
        """Words with their markers; a marker character of the text itself is a word of its own kind."""
        out: list[str] = []
        for i, part in enumerate(text.split(MARKER)):
            if i:
                out.append(LITERAL)
            marked = part.replace(" ", MARKER) if i else MARKER + part.replace(" ", MARKER)
            if self.words:
                out += self.words.findall(marked)
            elif marked:
                out.append(marked)
        return out

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. New ones are encoded together; all but long ones are remembered."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known = self.known
        known.update((w, self.before[w]) for w in words if w in self.before)
        new = [w for w in words if w not in known and w != LITERAL]
        short = [w for w in new if len(w) <= LONGEST_TOGETHER]
        known.update(zip(short, self._all_paths([w.replace(" ", MARKER) for w in short]), strict=True))
        rest = {w: _bytes(self._viterbi(w.replace(" ", MARKER))) for w in new if len(w) > LONGEST_TOGETHER}
        rest[LITERAL] = _bytes(tuple(self.byte_ids[b] for b in MARKER.encode()) if self.byte_ids else (self.unknown,))
        return [known[w] if w in known else rest[w] for w in words]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of some texts, and the number of words of each."""
        texts = texts.cast(pa.large_string())
        blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), nothing, pc.binary_join_element_wise(blank, texts, nothing))
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        blank, alone = raw == 32, np.isin(raw, list(self.alone.encode())) if self.alone else np.zeros(len(raw), bool)
        begins = blank | alone
        begins[1:] &= ~blank[:-1] | alone[1:]
        begins[1:] |= alone[:-1]
        first = ends[:-1] - ends[0]
        begins[first[first < len(raw)]] = True
        starts = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
        return words, np.diff(np.searchsorted(starts, ends - ends[0]))

    def encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts (no nulls) one after another, and how many each has."""
        by_hand = pc.match_substring(texts, MARKER).to_numpy(zero_copy_only=False) if self.words else np.ones(len(texts), bool)
        if by_hand.all():
            split = [[w.replace(MARKER, " ") if w != LITERAL else w for w in self._split(t)] if t else [] for t in texts.to_pylist()]
            words, counts = pa.array(chain.from_iterable(split), pa.large_string()), np.fromiter(map(len, split), np.int64, len(split))
        elif not by_hand.any():
            words, counts = self._cut(texts)
        else:
            parts = [self.encode_some(texts.filter(pa.array(mask))) for mask in (~by_hand, by_hand)]
            order = np.argsort(np.argsort(by_hand, kind="stable"))
            sizes = np.concatenate([p[1] for p in parts])
            pieces = np.split(np.concatenate([p[0] for p in parts]), np.cumsum(sizes)[:-1])
            return np.concatenate([pieces[i] for i in order]), sizes[order]
        coded = words.dictionary_encode()
        found = self._encoded(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, codes = np.frombuffer(b"".join(found), np.int32), coded.indices.to_numpy(zero_copy_only=False)
        each = length[codes]
        upto = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(length) - length)[codes] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(np.r_[0, upto][np.r_[0, np.cumsum(counts)]])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode_some(pa.array(texts, pa.large_string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Bytes stand as private characters, which no piece holds, until their runs are read as UTF-8."""
        text = BYTE_RUN.sub(lambda m: bytes(ord(c) - BYTE_AT for c in m[0]).decode("utf-8", "replace"), "".join(map(self.surface.__getitem__, ids)))
        return text[1:] if text.startswith(" ") else text

    def decode_some(self, lists: pa.Array) -> pa.Array:
        """Texts of some lists of ids; of null lists, null."""
        flat = lists.flatten()
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
        if "_raw" not in self.__dict__:
            self.__dict__["_raw"] = pa.array([bytes([self.bytes_of[i]]) if i in self.bytes_of else x.encode() for i, x in enumerate(self.surface)], pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.__dict__["_raw"].take(flat)), b"")
        joined = pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), joined)
        try:
            text = joined.cast(pa.string())
            return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1, None), text)
        except pa.ArrowInvalid:  # bytes that are no UTF-8: not made by encoding a text
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())

    def surfaces(self) -> list[str]:
        """Text of each piece as ``decode`` joins it."""
        return [
            "" if i in self.control else " ⁇ " if i == self.unknown else chr(BYTE_AT + self.bytes_of[i]) if i in self.bytes_of else p.replace(MARKER, " ")
            for i, p in enumerate(self.pieces)
        ]


def default_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def load_model(path: str) -> UnigramModel:
    """Pieces and scores of a model file; the trie is built here, once, on the driver."""
    import sentencepiece

    with open(path, "rb") as f:
        proto = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    control = {i for i in range(size) if sp.is_control(i) or sp.is_unused(i)}
    bytes_of = {i: int(pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
    byte_ids = [0] * 256 if len(bytes_of) == 256 else []
    for i, b in bytes_of.items() if byte_ids else ():
        byte_ids[b] = i
    normal = [i for i in range(size) if i not in control and i not in bytes_of and i != sp.unk_id()]
    logs = {i: sp.get_score(i) for i in normal} if is_unigram(proto) else {i: -math.log(rank + 1) for rank, i in enumerate(normal, 1)}
    scores = [round(logs.get(i, 0.0) * SCALE) for i in range(size)]
    lowest = round((min(logs.values(), default=0.0) - UNKNOWN_PENALTY) * SCALE)
    trie = DoubleArray.build([(pieces[i], i) for i in normal])
    words, alone = None, ""
    if not any(MARKER in pieces[i].lstrip(MARKER) for i in normal):
        alone = "".join(c for c in "\t\n\r" if c not in trie.symbols)
        words = re.compile(f"[{alone}]|{MARKER}*[^{MARKER}{alone}]+|{MARKER}+" if alone else f"{MARKER}*[^{MARKER}]+|{MARKER}+")
    return UnigramModel(pieces, scores, lowest, trie, bytes_of, byte_ids, sp.unk_id(), control, words, alone if words else "")


def is_unigram(proto: bytes) -> bool:
    """Whether the scores of a model file are log probabilities."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    return model.trainer_spec.model_type == model.trainer_spec.UNIGRAM


def _bytes(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _ids_of(model: UnigramModel, texts: pa.Array) -> pa.Array:
    ids, sizes = model.encode_some(pc.fill_null(texts, ""))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids), mask=texts.is_null())


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text in the column ``ids`` (replaced if present)."""
    return _mapped(docs, model_path, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda model, texts: [_ids_of(model, texts)])


def decode(docs: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the column ``ids`` stands for."""
    return _mapped(docs, model_path, ids, [T.StructField(text, T.StringType())], lambda model, lists: [model.decode_some(lists)])


def round_trip(docs: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids", same: str = "round_trip") -> DataFrame:
    """``docs`` without its text, with its piece ids and whether they decode to that very text (nulls do)."""

    def both(model: UnigramModel, texts: pa.Array) -> list[pa.Array]:
        lists = _ids_of(model, texts)
        return [lists, pc.fill_null(pc.equal(model.decode_some(lists), texts.cast(pa.string())), True)]

    return _mapped(docs, model_path, text, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(same, T.BooleanType())], both, drop=True)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are handled together."""
    if pa.types.is_list(column.type):
        size, most = pc.list_value_length(column), PIECES_TOGETHER
    else:
        size, most = pc.binary_length(column), BYTES_TOGETHER
    upto = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield start, end - start
        start = end


def _mapped(docs: DataFrame, model_path: str | None, source: str, made: list[T.StructField], apply: Callable[[UnigramModel, pa.Array], list[pa.Array]], drop: bool = False) -> DataFrame:
    """``docs`` with columns made from one."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path or default_model_path()))
    names = [f.name for f in made]
    kept = [c for c in docs.columns if c not in names and not (drop and c == source)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start, size in _slices(batch.column(source)):
                    part = batch.slice(start, size)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *apply(shared.value, part.column(source))], [*kept, *names])
        finally:  # a worker lives on after its task
            shared.value.known.clear()
            shared.value.before.clear()
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *made]))
