"""SentencePiece encoding by a forward pass over a trie of distinct marked words, and decoding.

Words are marked with the white space before them; sorted, they form a trie. The forward state of a prefix is
the last piece of its best segmentation, so it is worked out once for all words that begin with it. The given
vocabulary is of the merging kind: a piece may follow another where merging both together gives just these two
(any other path scores minus infinity), which leaves one path per prefix.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx

MARK = "▁"
REMEMBERED = 250_000  # words kept between batches, twice


def default_model() -> str:
    """The installed piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary of merging pieces with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(names) if not special(i)}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on after a space need another cut into words")
        self.surface = [b"" if special(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)
        self.width = np.array([len(x) for x in self.surface], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.stories: dict[str, list] = {}
        whole = [p for p in self.ids if self.merged(p) == [p]]  # others never come out of merging
        self.tails = {p[i:]: False for p in whole for i in range(1, len(p))} | dict.fromkeys(whole, True)
        # words may be cut wherever no piece goes across
        self.cut = _LETTERS if all(len(_LETTERS.findall(p)) == 1 for p in whole) else _WORD
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until nothing merges; ``steps`` gets the score of each
        merge and the first and last part after it."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def story(self, piece: str) -> list:
        """How a piece comes about, step by step."""
        known = self.stories.get(piece)
        if known is None:
            known = self.stories[piece] = []
            self.merged(piece, known)
        return known

    def follows(self, first: str, second: str) -> bool:
        """Whether the two pieces stay apart side by side: no merge across ever comes before their own."""
        left, right, get = self.story(first), self.story(second), self.score.get
        a, b, i, j = first[-1], second[0], 0, 0
        while True:
            mine = left[i][0] if i < len(left) else None
            other = right[j][0] if j < len(right) else None
            across = get(a + b)
            if across is not None and (mine is None or across > mine) and (other is None or across >= other):
                apart = False
                break
            if mine is None and other is None:
                apart = True
                break
            if other is None or mine is not None and mine >= other:
                a, i = left[i][2], i + 1
            else:
                b, j = right[j][1], j + 1
        self.beside[first, second] = apart
        return apart

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of every word of a sorted list, walked as a trie.

        The last piece is kept for each place of the current word, so a common beginning is worked out once.
        """
        last: list[str] = []  # of each prefix of the current word
        before, tails, beside = "", self.tails, self.beside
        for word in words:
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                found, begin = [], end - 1
                while begin >= 0 and (whole := tails.get(word[begin:end])) is not None:
                    if whole:
                        found.append(begin)
                    begin -= 1
                for begin in reversed(found):
                    piece = word[begin:end]
                    if not begin:
                        break
                    apart = beside.get((last[begin - 1], piece))
                    if apart or apart is None and self.follows(last[begin - 1], piece):
                        break
                else:
                    piece = word[end - 1]
                last.append(piece)
            before, out, end = word, [], len(word)
            while end:
                out.append(last[end - 1])
                end -= len(out[-1])
            yield word, out[::-1]

    def packed(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for p in parts:
            if p in self.ids:
                ids.append(self.ids[p])
            else:
                ids += [self.bytes[b] for b in p.encode()]
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; an empty text has none."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self.words) > REMEMBERED:  # words seen since the last turn are taken over as they come again
            self.older, self.words = self.words, {}
        wanted -= self.words.keys()
        again = wanted & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        wanted -= again
        if len(self.beside) > 4 * REMEMBERED:
            self.beside.clear()
        for word, parts in self.segment(sorted(wanted)):
            self.words[word] = self.packed(parts)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts behind so many ids each; the space that marks the first word goes."""
        size = self.width[ids]
        reach = np.cumsum(size)
        take = np.repeat(self.begin[ids] - (reach - size), size) + np.arange(reach[-1] if len(reach) else 0)
        raw = self.letters[take].tobytes()
        stops = np.concatenate(([0], reach))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:], strict=False))
        return [t.removeprefix(" ") for t in texts]


# A run of spaces with what follows it, up to the next space or, in the finer cut, to where letters begin or end.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LETTERS = re.compile(f"{MARK}*[^\\W\\d_]+|{MARK}*(?:[\\W\\d_](?<!{MARK}))+|{MARK}+")
_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array<int>). A null or empty text has no ids.

    Repeated rows and null ids are encoded like others; an empty table gives an empty result; other columns are
    ignored.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                packed = pieces.encode(texts.slice(a, b - a).to_pylist())
                edges = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a last column ``text``, decoded from the ids; null ids give a null text."""
    path = model or default_model()
    names = [c for c in encoded.columns if c != "text"]
    place = names.index(ids_col)
    rows = encoded.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            lists, texts = batch.column(place), []
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy()
            edges = np.concatenate(([0], np.cumsum(counts)))
            for at in range(0, len(counts), 200):
                some = slice(at, at + 200)
                texts += pieces.decode(ids[edges[at] : edges[min(at + 200, len(counts))]], counts[some])
            column = pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, "text"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, ddl + ", text string")
