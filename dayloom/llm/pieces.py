"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once; at every position its output links name all pieces that end
there, longest first, and each relaxes the best score of that position.  No piece has a space
mark after another character, so the best path always breaks before a word's mark; the pass
runs from break to break and remembers the words it has met first.  The table of pieces is read on the
driver (its size is the vocabulary's) and sent along; nothing is trained.
"""

import re
from array import array
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.common import parts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs beyond the worst piece.
UNKNOWN = 10.0
#: Words a Python worker remembers at most, and the longest of them.
WORDS, WORD_CHARS = 500_000, 64


def read_pieces(path: str = MODEL):
    """[(piece, score, kind)] in id order; kind: normal, byte, unknown or control."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: ("byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else
                      "control" if model.is_control(i) or model.is_unused(i) else "normal")
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Pieces:
    def __init__(self, rows):
        self.byte = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(rows) if kind == "byte"}
        #: text of each piece; a byte below 128 is a character of its own, the others (high) join up
        self.text = np.array([p.replace(SPACE, " ") if kind == "normal" else chr(self.byte[i]) if self.byte.get(i, 128) < 128 else ""
                              for i, (p, _, kind) in enumerate(rows)], object)
        self.high = np.array([self.byte.get(i, 0) > 127 for i in range(len(rows))])
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.unknown_id = next((i for i, r in enumerate(rows) if r[2] == "unknown"), 0)
        normal = {p: (len(p), score, i) for i, (p, score, kind) in enumerate(rows) if kind == "normal"}
        self.single = {p for p in normal if len(p) == 1}
        self.unknown_score = min(s for _, s, _ in normal.values()) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for p, found in normal.items():
            self.automaton.add_word(p, found)
        self.automaton.make_automaton()
        breaks = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if breaks else "(?s).+")
        self.inside = {p[k:k + 2] for p in normal for k in range(len(p) - 1)}
        self.known = {}

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equals, the one with longer last pieces."""
        best, back, ids, seen = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1), [None] * (len(text) + 1), 0
        unknown = not self.single.issuperset(text)

        def relax_unknown(upto):
            for p in range(seen, upto):
                if text[p] not in self.single and best[p] + self.unknown_score > best[p + 1]:
                    best[p + 1], back[p + 1], ids[p + 1] = best[p] + self.unknown_score, 1, None

        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            if unknown and end > seen:
                relax_unknown(end)
                seen = end
            score += best[end - length]
            if score > best[end]:
                best[end], back[end], ids[end] = score, length, i
        if unknown:
            relax_unknown(len(text))
        out, at = [], len(text)
        while at:
            start, i = at - back[at], ids[at]
            if i is None:
                spelled = [self.byte_id.get(b) for b in text[start:at].encode()]
                out += [self.unknown_id] if None in spelled else spelled[::-1]
            else:
                out.append(i)
            at = start
        out.reverse()
        return out

    def _remember(self, text, found):
        """The first WORDS words met are kept: frequent ones come early."""
        if len(text) <= WORD_CHARS and len(self.known) < WORDS:
            self.known[text] = found
        return found

    def _between(self, unit):
        """Ids of one word: no piece holds two characters that no piece has side by side, so the path breaks there too."""
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1:k + 1] not in self.inside), len(unit)]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            part = unit[a:b]
            found = self.known.get(part)
            parts.append(found if found is not None else self._remember(part, array("i", self.best_path(part)).tobytes()))
        return parts[0] if len(parts) == 1 else self._remember(unit, b"".join(parts))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after the other; none for an empty text."""
        if not text:
            return b""
        known, between = self.known.get, self._between
        return b"".join([known(u) or between(u) for u in self.unit.findall(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids) -> str:
        """The text of ids: runs of byte pieces are read as UTF-8, the first space mark is dropped."""
        ids = np.asarray(ids, np.int64)
        if self.high[ids].any():
            parts, held = [], bytearray()
            for i in ids.tolist():
                if i in self.byte:
                    held.append(self.byte[i])
                else:
                    parts += [held.decode(errors="replace"), self.text[i]]
                    held = bytearray()
            text = "".join([*parts, held.decode(errors="replace")])
        else:
            text = "".join(self.text[ids])
        return text[1:] if text[:1] == " " else text


_MODELS = {}


def _model(rows):
    """One automaton and one memory of words for all tasks of a Python worker."""
    key = hash(tuple(rows))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Pieces(rows)
    return _MODELS[key]


def _strings(column):
    return [x or "" for x in column.to_pylist()]


def _vocabulary(df, pieces):
    return df.sparkSession.sparkContext.broadcast(pieces or read_pieces())


def _rows_and_texts(docs):
    return docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), "text")


def _encoder(rows):
    def run(batches):
        model = _model(rows.value)
        for batch in batches:
            coded = [model.encode(t) for t in _strings(batch.column(1))]
            offsets = np.fromiter(accumulate((len(c) // 4 for c in coded), initial=0), np.int32, len(coded) + 1)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row", "ids"])

    return run


def _decoder(rows):
    def run(batches):
        model = _model(rows.value)
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [model.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["row", "ids", "text"])

    return run


def _both_ways(rows):
    encoded, decoded = _encoder(rows), _decoder(rows)

    def run(batches):
        yield from decoded(encoded(parts(batches)))
        _model(rows.value).known.clear()  # the worker lives on, in stages that have no use for these words

    return run


def encode(docs: DataFrame, pieces=None) -> DataFrame:
    """``docs`` with its text as ``ids`` (array of int) in place of ``text``.

    In: ``text`` and any further columns, kept in a struct ``row`` so no name can clash.  Out:
    (row, ids).  A null or empty text has no ids.  A literal space mark reads as a space.  Of two
    ways with equal scores the same one is taken everywhere, so equal texts have equal ids;
    repeated rows stay repeated.  A long text is coded whole, unit by unit.
    An empty table gives an empty table.
    """
    given = _rows_and_texts(docs)
    return given.mapInArrow(_encoder(_vocabulary(docs, pieces)), f"row {given.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, pieces=None) -> DataFrame:
    """(row, ids, text): ``coded`` (row, ids) with its text; null ids read as none."""
    coded = coded.select("row", "ids")
    return coded.mapInArrow(_decoder(_vocabulary(coded, pieces)), f"row {coded.schema['row'].dataType.simpleString()}, ids array<int>, text string")


def there_and_back(docs: DataFrame, pieces=None) -> DataFrame:
    """(row, ids, text): ``decode(encode(docs))`` in one Python worker a task, so a task holds one automaton and one memory of words.

    The memory ends with the task: the stages of a pipeline share their workers.
    """
    given = _rows_and_texts(docs)
    return given.mapInArrow(_both_ways(_vocabulary(docs, pieces)),
                            f"row {given.schema['row'].dataType.simpleString()}, ids array<int>, text string")


def op6_pieces(spark, sf_dir):
    """Every document's ids, and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = read_pieces()
    back = decode(encode(docs, rows), rows)
    return back.select("row.doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
