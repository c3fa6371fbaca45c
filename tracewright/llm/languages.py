"""The language of documents and of their segments (problem 9).

Words are scored by a unigram model over the pieces of a fixed public vocabulary: the probability
of a word in a language is the sum, over all ways to cut it into pieces, of the product of the
pieces' probabilities, computed by the forward algorithm; the piece probabilities come from
expectation maximisation over the same lattice. A class of its own stands for code and log lines.
Sentences take their words' sum; segments are the runs of a Viterbi path through a text's
sentences.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Model file whose pieces are the vocabulary; a bare name is looked up in the installed collection.
VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents that the model is fitted on: about so many, drawn by a hash of the id, and at
#: most twice as many ever reach the driver.
SAMPLE = 2000
#: Rounds of relabelling the sample's sentences and fitting again; rounds of maximisation in each.
ROUNDS, STEPS = 3, 2
#: Probabilities below this are scaled up; words that a task remembers with their scores.
TINY, WORDS = 1e-200, 500_000
#: Log-odds against a change of language between sentences of a paragraph, and between paragraphs.
SWITCH, SWITCH_PARAGRAPH = 3.0, 1.5
#: Words sharing no piece with a language are not more than this unlikely there, against the best.
FLOOR = -9.0

# The languages, and their ISO 639-1, 639-2 and English names.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru")
SPELLINGS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "ru": ("rus", "russian"),
}
CODE = len(LANGUAGES)
_NAMED = {s: code for code, more in SPELLINGS.items() for s in (code, *more)}
_SHARP = {"ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue"}
_EDGE = "\"'.,:;!?()[]{}<>«»„“”‘’…-–—*#>|/`~​﻿"
_FINAL = re.compile(r"[.!?…][\"'’”»)\]]*\Z")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_HUMP = re.compile(r"[a-z][A-Z]")
_PREFIX = re.compile(r"[ \t]*(?:(?:>+|\*+|//+|#+|\+|\||!+|--|;;)[ \t]+|>+)*")
_MARKED = frozenset(" \t>*/#+|!-;")
_CODE_CHAR = re.compile(r"[{}=;(&|+>:]|^\s*[)\]}]")
_CODE_MARK = re.compile(r"[{}=;]|::|->|\+\+|&&|\|\||\w\(|\w \(\w*[,)&]|^\s*[)\]}]")
_LOG_LINE = re.compile(r"\s*(?:(?:X?FAIL|X?PASS|KFAIL|UNRESOLVED|UNTESTED|UNSUPPORTED|ERROR|WARNING|WARN|INFO|DEBUG|TRACE): \S+[./]|\S+:\d+(?::\d+)?:\s)")
#: What a sentence of fewer words says of its language counts in proportion to its words.
FULL_WORDS = 3
#: A paragraph is code if its words are likeliest in the code class, with the lead in log-probability
#: or without it where this share of its lines have marks of code. Before the first fit, marks alone decide.
CODE_LINES, CODE_LEAD = 0.3, 2.0


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label in a usual spelling (code, region, English name), else None."""
    if not label:
        return None
    parts = [p for p in re.split(r"[^a-z]+", label.strip().lower()) if p]
    if parts and parts[0] in _NAMED:
        return _NAMED[parts[0]]
    return next((_NAMED[p] for p in parts if len(p) > 3 and p in _NAMED), None)


def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss").replace("’", "'")


def plain_word(token: str) -> str | None:
    """A token as a word of a language, or None: names with digits, underscores, dots or humps."""
    if not token.isalpha():
        token = token.strip(_EDGE)
        if not _PLAIN.match(token):
            return None
    if _HUMP.search(token):
        return None
    return fold(token)


def pieces_of(vocabulary: str) -> list[str]:
    """Folded pieces of a sentencepiece model; ``▁`` marks a word's beginning."""
    import sentencepiece

    path = vocabulary
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    folded = {("▁" if p.startswith("▁") else "") + fold(p.lstrip("▁")) for p in (model.id_to_piece(i) for i in range(model.vocab_size())) if not p.startswith("<")}
    return sorted(p for p in folded if p and all(c.isalpha() or c in "▁'-" for c in p))


@dataclass
class Model:
    """Piece log-probabilities of every class, and the scores of words seen so far."""

    index: dict[str, int]
    prob: np.ndarray  # pieces x classes
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.index), default=1)

    def __getstate__(self) -> dict:
        return {"index": self.index, "prob": self.prob, "cache": {}, "longest": self.longest}

    def lattice(self, word: str) -> list[list[tuple[int, int]]]:
        """For every end in the marked word, the (begin, piece) that end there."""
        text = "▁" + word
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - self.longest), end):
                k = self.index.get(text[begin:end])
                if k is not None:
                    out[end].append((begin, k))
        return out

    def forward(self, lattice: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of everything up to each place, and the logarithm of what that was divided by, so
        that words of any length keep their digits."""
        alpha = np.zeros((len(lattice), self.prob.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros(len(lattice))
        scaled = False
        for end in range(1, len(lattice)):
            if scaled and lattice[end]:
                scale[end] = max(scale[begin] for begin, _ in lattice[end])
                for begin, k in lattice[end]:
                    alpha[end] += alpha[begin] * self.prob[k] * np.exp(scale[begin] - scale[end])
            else:
                for begin, k in lattice[end]:
                    alpha[end] += alpha[begin] * self.prob[k]
            top = alpha[end].max()
            if 0 < top < TINY:
                alpha[end] /= top
                scale[end] += np.log(top)
                scaled = True
        return alpha, scale

    def score(self, word: str) -> np.ndarray:
        """Log-probability of the word in every class, cut off at ``FLOOR`` below the best."""
        found = self.cache.get(word)
        if found is None:
            with np.errstate(divide="ignore"):
                raw = np.log(self.forward(self.lattice(word))[0][-1])
            best = raw.max()
            found = np.maximum(raw - best, FLOOR) if np.isfinite(best) else np.zeros(len(raw))
            self.cache[word] = found
        return found


def fit(counts: dict[str, np.ndarray], vocabulary: list[str], steps: int = STEPS) -> Model:
    """Piece probabilities by expectation maximisation from word counts (word -> count by class)."""
    letters = {c for w in counts for c in "▁" + w}
    index = {p: k for k, p in enumerate(sorted({*vocabulary, *letters}))}
    classes = len(next(iter(counts.values())))
    model = Model(index, np.full((len(index), classes), 1.0 / len(index)))
    lattices = {w: model.lattice(w) for w in counts}
    for step in range(steps):
        expected = np.full((len(index), classes), 1e-4)
        for word, n in counts.items():
            lattice = lattices[word]
            alpha, scale = model.forward(lattice)
            scaled = scale.any()
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            weight = np.where(alpha[-1] > 0, n / np.maximum(alpha[-1], 1e-300), 0.0)
            for end in range(len(lattice) - 1, 0, -1):
                for begin, k in lattice[end]:
                    # Beta is kept in the units in which alpha is divided, so their product is whole.
                    step_prob = model.prob[k] * beta[end] * (np.exp(scale[begin] - scale[end]) if scaled else 1.0)
                    beta[begin] += step_prob
                    expected[k] += weight * alpha[begin] * step_prob
        model.prob = expected / expected.sum(axis=0)
    return model


class Reader:
    """Cuts texts into sentences of known words; remembers what each token is."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}  # word -> row; row 0 stands for no word
        self.words: list[str] = [""]
        self.memo: dict[str, int] = {}

    def _code(self, token: str) -> int:
        word = plain_word(token)
        row = 0
        if word:
            row = self.row.get(word, 0)
            if not row:
                row = self.row[word] = len(self.words)
                self.words.append(word)
        code = row * 2 + bool(_FINAL.search(token))
        if len(self.memo) < 300_000:
            self.memo[token] = code
        return code

    def rows(self, tokens: list[str]) -> np.ndarray:
        memo, slow = self.memo.get, self._code
        return np.fromiter((c if (c := memo(t)) is not None else slow(t) for t in tokens), np.int64, len(tokens))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Word rows, sentence ends, paragraph of each token; marks share of each paragraph; tokens in fences.

        Quoting and comment marks are taken off, wrapped lines joined, log lines left out.
        """
        tokens: list[str] = []
        para: list[int] = []
        lengths: list[int] = []
        marks: list[int] = []
        lines: list[int] = []
        fenced_tokens: list[str] = []
        fenced, at = False, -1
        fresh = True
        for line in text.replace("\r", "").split("\n"):
            if not line or line.isspace():
                fresh = True
                continue
            if "```" in line or "~~~" in line:
                fenced, fresh = not fenced, True
                continue
            if fenced:
                fenced_tokens += line.split()
                continue
            if _LOG_LINE.match(line):
                fresh = True
                continue
            if fresh:
                at, fresh = at + 1, False
                marks.append(0)
                lines.append(0)
            if line[0] in _MARKED:
                line = line[_PREFIX.match(line).end() :]
            lines[at] += 1
            if _CODE_CHAR.search(line) and _CODE_MARK.search(line):
                marks[at] += 1
            words = line.split()
            tokens += words
            para.append(at)
            lengths.append(len(words))
        codes = self.rows(tokens)
        paragraph = np.repeat(np.array(para, np.int64), lengths)
        ends = (codes & 1).astype(bool)
        if len(ends):
            ends[:-1] |= np.diff(paragraph) != 0
            ends[-1] = True
        return codes >> 1, ends, paragraph, np.array(marks) / np.maximum(lines, 1), fenced_tokens


class Scores:
    """Scores of the words that a reader has met, row by row, filled in as they appear."""

    def __init__(self, model: Model, reader: Reader):
        self.model, self.reader = model, reader
        self.table = np.zeros((1024, CODE + 1))
        self.known = 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        total = len(self.reader.words)
        if total > self.known:
            if total > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(total, len(self.table)), CODE + 1))])
            for k in range(self.known, total):
                self.table[k] = self.model.score(self.reader.words[k])
            self.known = total
        return self.table[rows]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    return np.add.reduceat(values, starts, axis=0)


def judged(reader: Reader, scores: Scores | None, text: str):
    """Sentences of a text: scores (or None), word rows, ends, paragraph of each sentence, code rows.

    Paragraphs of code are taken out; their words, and those of fences, are the code rows.
    """
    rows, ends, paragraph, marks, fenced = reader.read(text)
    code_rows = reader.rows(fenced) >> 1 if fenced else np.zeros(0, np.int64)
    if not len(rows):
        return None, rows, ends, paragraph, code_rows
    values = scores.of(rows) if scores else None
    is_code = marks >= CODE_LINES
    if scores:
        last = np.append(np.diff(paragraph) != 0, True)
        total = np.zeros((len(marks), CODE + 1))
        total[paragraph[last]] = _sums(values, last)
        lead = total[:, CODE] - total[:, :CODE].max(axis=1)
        is_code = (is_code & (lead >= 0)) | (lead > CODE_LEAD)
    keep = ~is_code[paragraph]
    code_rows = np.concatenate([code_rows, rows[~keep]])
    rows, ends, paragraph = rows[keep], ends[keep], paragraph[keep]
    if not len(rows):
        return None, rows, ends, paragraph, code_rows
    return (values[keep] if scores else None), rows, ends, paragraph[ends], code_rows


def train(texts: list[tuple[str, str]], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """Model from (text, language code) rows with some wrong labels.

    The first fit takes every sentence to be in its document's language and fenced lines to be
    code; later ones relabel sentences and paragraphs by the last fit.
    """
    reader = Reader()
    model: Model | None = None
    for _ in range(rounds):
        scores = Scores(model, reader) if model else None
        labels: list[np.ndarray] = []
        seen: list[np.ndarray] = []
        for text, code in texts:
            values, rows, ends, _, code_rows = judged(reader, scores, text)
            if len(code_rows):
                seen.append(code_rows)
                labels.append(np.full(len(code_rows), CODE))
            if len(rows):
                label = np.full(int(ends.sum()), LANGUAGES.index(code))
                if values is not None:
                    label = _sums(values, ends)[:, :CODE].argmax(axis=1)
                sentence = np.cumsum(ends) - ends
                seen.append(rows)
                labels.append(label[sentence])
        counts = np.zeros((len(reader.words), CODE + 1))
        np.add.at(counts, (np.concatenate(seen), np.concatenate(labels)), 1.0)
        counts[0] = 0
        # Every class weighs the same, however many of the rows are in it.
        counts *= 1e5 / np.maximum(counts.sum(axis=0), 1)
        model = fit({reader.words[k]: counts[k] for k in np.flatnonzero(counts.sum(axis=1))}, vocabulary)
    return model


def segment(reader: Reader, scores: Scores, text: str) -> list[tuple[int, float, int]]:
    """(language, confidence, words) of every segment in reading order."""
    values, rows, ends, paragraph, _ = judged(reader, scores, text)
    if values is None:
        return []
    total = _sums(values, ends)[:, :CODE]
    size = _sums((rows > 0).astype(np.int64), ends)
    told = size > 0
    if not told.any():
        return []
    total, size, paragraph = total[told], size[told], paragraph[told]
    total = total * np.minimum(1.0, size / FULL_WORDS)[:, None] if (size >= FULL_WORDS).any() else total
    n = len(total)
    if (total.argmax(axis=1) == total[0].argmax()).all():
        path = [int(total[0].argmax())] * n
    else:
        best = total[0]
        back = np.zeros((n, CODE), np.int64)
        for i in range(1, n):
            cost = SWITCH_PARAGRAPH if paragraph[i] != paragraph[i - 1] else SWITCH
            top = int(best.argmax())
            switched = best[top] - cost
            back[i] = np.where(best >= switched, np.arange(CODE), top)
            best = np.maximum(best, switched) + total[i]
        path = [int(best.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
    out: list[tuple[int, float, int]] = []
    begin = 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[begin]:
            whole = total[begin:i].sum(axis=0)
            p = np.exp(whole - whole.max())
            out.append((path[begin], float(p[path[begin]] / p.sum()), int(size[begin:i].sum())))
            begin = i
    return out


def sample(documents: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, code) of about ``size`` labelled documents, at most twice as many, drawn by hash."""
    named = sorted({s for s in _NAMED})
    head = F.lower(F.regexp_extract(F.trim("lang"), r"^[A-Za-z]+", 0))
    labelled = documents.where("doc_id is not null and text is not null").where(head.isin(*named))
    count = labelled.select("doc_id").count()
    share = min(1.0, size / max(1, count))
    rows = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) or 1)).select("doc_id", "text", "lang").limit(2 * size).collect()
    return [(r.text, c) for r in sorted(rows, key=lambda r: r.doc_id) if (c := label_code(r.lang))]


def segments(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = SAMPLE) -> DataFrame:
    """doc_id, seg_no, lang, confidence, words, segments, label_code of every segment of every text.

    Texts without any sentence in a language (null, empty, code only) give no row. Repeated rows
    count once; null ids give none; extra columns are ignored. Without any labelled row there is
    nothing to learn from, and no segment is found.
    """
    schema = "doc_id bigint, seg_no bigint, lang string, confidence double, words int, segments int, label_code string"
    rows = sample(documents, size)
    model = train(rows, pieces_of(vocabulary)) if rows else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        scores = Scores(model, reader) if model is not None else None
        for part in parts:
            out: list[tuple] = []
            if scores is not None and len(reader.words) > WORDS:  # what is remembered stays bounded
                reader = Reader()
                model.cache.clear()
                scores = Scores(model, reader)
            for doc, text, label in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if text and scores is not None:
                    found = segment(reader, scores, text)
                    code = label_code(label)
                    out += [(doc, k + 1, LANGUAGES[l], round(c, 6), w, len(found), code) for k, (l, c, w) in enumerate(found)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    return documents.where("doc_id is not null").select("doc_id", "text", "lang").mapInArrow(run, schema).dropDuplicates(["doc_id", "seg_no"])


def mislabelled(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = SAMPLE) -> DataFrame:
    """doc_id, seg_no, lang, confidence of documents in several languages or with another label than theirs."""
    found = segments(documents, vocabulary, size)
    return found.where("segments > 1 or label_code is null or label_code <> lang").select("doc_id", "seg_no", "lang", "confidence")
