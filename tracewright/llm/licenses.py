"""Licences of source files and projects (problem 2).

A text states a licence by a tag (``SPDX-License-Identifier:``, ``License:``, ``Terms:``), by a
granting sentence that names it, or by its wording. Both are compared with the reference table by
the Dice coefficient of word-bigram sets: wording with the table's notices and bodies, and the words
behind a tag or a grant with the names that its ids and titles give rise to. The best match at or
above the threshold counts, else nothing is stated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..session import cut_lineage
from .source_text import LICENSE_FILE_NAMES, comment_text, opening_comment, suffix

#: Least Dice coefficient at which wording counts as a template's.
DICE = 0.6
#: Most bytes of template text that are sent to every task; a larger table is refused.
TEMPLATE_BYTES = 4 << 20

#: Least Dice coefficient of a name, whose bigrams are few; most words that a name is read from.
NAME_DICE, NAME_WORDS = 0.8, 14

# Names by which licences go besides their ids and titles; None is one that isn't in any table.
ALIASES = (
    ("expat", "MIT"), ("x11", "MIT"), ("mit x11", "MIT"), ("new bsd", "BSD-3-Clause"), ("modified bsd", "BSD-3-Clause"), ("revised bsd", "BSD-3-Clause"), ("simplified bsd", None),
    ("al", "Apache-2.0"), ("asl", "Apache-2.0"), ("zlib png", "Zlib"), ("zlib libpng", "Zlib"),
)
# Words that name nothing, words for one another, and words for numbers.
FILLERS = frozenset("the a of terms under license licence licenses version edition clause software v".split())
SAME_WORDS = {"library": "lesser"}
NUMBERS = {"zero": "0", "two": "2", "three": "3", "four": "4", "second": "2", "third": "3", "first": "1"}
_PLUS_WORDS = re.compile(r"\+|[\s,-]*\b(?:or|and)[\s-]+(?:any[\s-]+)?(?:later|newer|higher)\b(?:[\s-]+(?:version|edition|one)\b)?|\(>=\s*(?=\w)", re.I)
_ONLY_WORDS = re.compile(r"[\s,-]*\bonly\b|[\s,]*\band\s+no\s+other\b|[\s,]*\balone\b", re.I)
_NAME_WORD = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*|\+|>=")
_BETWEEN = re.compile(r"[\s,/()-]*")
_EDGE = re.compile(r"(?![\w+]|-\w|\.\d)")
_TAG = re.compile(r"\bspdx-licen[sc]e-identifier\s*:\s*|(?<![\w-])licen[sc]e\s*:\s*|(?<![\w-])terms\s*:\s*", re.I)
_GRANT = re.compile(
    r"\b(?:distributed|released|licen[sc]ed|governed|covered|available|provided|supplied|offered|used|published|redistributed|"
    r"is|are|be|falls?|take|use|copy)\b",
    re.I,
)
_UNDER = re.compile(r"\b(?:under|by)\s+(?=\S)", re.I)
_EITHER = re.compile(r"\bunder\s+(?:either|any|one)\s+of\b[^:]*:\s*", re.I)
_NO_GRANT = re.compile(
    r"not\s+to\s+be\s+confused|grants?\s+nothing|nothing\s+was\s+decided|\bdraft\b|\bnot\s+(?:under|covered|licen[sc]ed|distributed)|"
    r"\bno\s+longer\b|\bformerly\b|\bunlike\b|\bpreviously\b",
    re.I,
)
_OR = re.compile(r"[\s,()]*(?:\bor\b|\|\|?)[\s(]*(?:under\s+|at\s+your\s+(?:choice|option)\s+)?", re.I)
_AND = re.compile(r"[\s,()]*\band\b[\s(]*", re.I)
_BULLET = re.compile(r"[\s,;.]*(?:[-*•]\s*|\bor\b\s*)", re.I)
_SENTENCE = re.compile(r"(?<=[.;!?])\s+(?=\S)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_OWNER_LINE = re.compile(r"^\W*(?:copyright\b|\(c\)|©).*$", re.I | re.M)

Choice = frozenset


@dataclass(frozen=True)
class Name:
    """A licence's name: the words of its family, its version and whether later ones are meant ('plus'), or no other ('only')."""

    words: tuple[str, ...]
    version: str = ""
    scope: str = ""


def name_of(text: str) -> Name | None:
    """The parts of a name, in whatever order and spelling; None if it holds two versions or contradicts itself."""
    plus, only = bool(_PLUS_WORDS.search(text)), bool(_ONLY_WORDS.search(text))
    rest = _ONLY_WORDS.sub(" ", _PLUS_WORDS.sub(" ", text)).lower()
    words: list[str] = []
    versions: set[str] = set()
    for m in _NAME_WORD.finditer(rest):
        word = m[0]
        if word.endswith("v") and len(word) > 1 and rest[m.end() : m.end() + 1].isdigit():
            word = word[:-1]  # as in GPLv2
        if word == "x" and rest[m.end() : m.end() + 2] == "11":
            word = "x11"
        word = SAME_WORDS.get(word, word)
        number = NUMBERS.get(word, word)
        if number[0].isdigit():
            if not (number == "11" and words[-1:] == ["x11"]):
                versions.add(number)
        elif word not in FILLERS:
            words.append(word)
    if len(versions) > 1 or plus and only:
        return None
    return Name(tuple(words), versions.pop() if versions else "", "plus" if plus else "only" if only else "")


def _pairs(words: tuple[str, ...]) -> frozenset:
    return frozenset(zip(("", *words), (*words, "")))


def dice(one: frozenset, other: frozenset) -> float:
    return 2 * len(one & other) / (len(one) + len(other)) if one or other else 0.0


def _same_version(said: str, meant: str) -> bool:
    """A version said without its minor number means any."""
    bare = lambda v: v.removesuffix(".0")
    return bare(said) == bare(meant) or "." not in said and said == meant.split(".")[0]


def known_names(rows: list[tuple[str, str, str, str]]) -> list[tuple[str | None, Name]]:
    """(licence id, name) of all names that the ids and titles of a reference table give rise to.

    A title's words may be shortened to the id's letters where these are its initials (of another row
    too: GNU Lesser GPL), lose the maker in front, or shrink to their first where no other row begins
    so. Of an edition that the table has only with, or only without, later ones the other scope is a
    name of no listed licence.
    """
    parsed = [(i, name_of(i), name_of(t)) for i, t, *_ in rows]
    parsed = [(i, a or Name(()), b or Name(())) for i, a, b in parsed]
    short = {a.words[0]: b.words for _, a, b in parsed if len(a.words) == 1 and len(b.words) > 1}
    tails = {k: next((w[n:] for n in range(len(w)) if "".join(x[0] for x in w[n:]) + "l" == k), None) for k, w in short.items()}
    out: list[tuple[str | None, Name]] = []
    for license_id, by_id, by_title in parsed:
        version, scope = by_id.version or by_title.version, by_id.scope or by_title.scope
        families = {by_id.words, by_title.words}
        for k, tail in tails.items():
            if tail and by_title.words[-len(tail) :] == tail:
                families.add((*by_title.words[: -len(tail)], k))
        families |= {f[1:] for f in families if len(f) > 1 and sum(f[:1] == b.words[:1] for _, _, b in parsed) > 1}
        first = by_title.words[:1]
        if sum(first == b.words[:1] for _, _, b in parsed) == 1:
            families.add(first)
        families |= {name_of(alias).words for alias, i in ALIASES if i == license_id}
        for family in filter(None, families):
            out.append((license_id, Name(family, version, scope)))
            if scope:
                out.append((None, Name(family, version, "only" if scope == "plus" else "plus")))
    listed = {(n.words, n.version, n.scope) for i, n in out if i}
    out = [(i, n) for i, n in out if i or (n.words, n.version, n.scope) not in listed]
    return out + [(None, name_of(alias)) for alias, i in ALIASES if i is None]


@dataclass
class Reader:
    """Finds the statements of a text. Built from (license_id, title, notice, body) rows."""

    rows: list[tuple[str, str, str, str]]
    dice: float = DICE
    names: list[tuple[str | None, Name, frozenset]] = field(default_factory=list)
    templates: list[tuple[str, int, frozenset]] = field(default_factory=list)
    of_bigram: dict[tuple[str, str], list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.names = [(i, n, _pairs(n.words)) for i, n in known_names(self.rows)]
        for license_id, _, *texts in self.rows:
            for text in texts:
                words = _WORD.findall((text or "").lower())
                if len(words) > 3:
                    pairs = frozenset(zip(words, words[1:]))
                    for pair in pairs:
                        self.of_bigram.setdefault(pair, []).append(len(self.templates))
                    self.templates.append((license_id, len(words), pairs))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("statements", "named")}  # the caches stay at home

    def __getattr__(self, name: str):
        if name not in ("statements", "named"):
            raise AttributeError(name)
        setattr(self, name, lru_cache(maxsize=20_000)(getattr(self, f"_{name}")))
        return self.__dict__[name]

    def _named(self, phrase: str) -> tuple[str | None, float]:
        """The licence whose name a phrase comes nearest to, and their Dice coefficient; None if that isn't a listed one.

        A version or scope that is said has to be the licence's; one that isn't said has to leave a
        single licence.
        """
        said = name_of(phrase)
        if said is None or not said.words:
            return None, 0.0
        own = _pairs(said.words)
        best, found = 0.0, set()
        for license_id, name, pairs in self.names:
            if said.version and (not name.version or not _same_version(said.version, name.version)) or said.scope and said.scope != name.scope:
                continue
            score = dice(own, pairs)
            if score >= NAME_DICE and score >= best:
                if score > best:
                    best, found = score, set()
                if license_id or said.scope:
                    found.add(license_id)
                elif not name.scope:
                    found.add(None)
        return (next(iter(found)) if len(found) == 1 else None), best

    def name_at(self, text: str, at: int) -> tuple[str | None, int] | None:
        """The licence named at a place: its id (None if it isn't listed) and where the name ends."""
        best: tuple[float, int, str | None] | None = None
        begin = at = _BETWEEN.match(text, at).end()
        for _ in range(NAME_WORDS):
            m = _NAME_WORD.match(text, at)
            if not m:
                break
            at = m.end()
            if _EDGE.match(text, at) and m[0].lower() not in ("the", "a", "of", "under"):
                close = at + (text[begin:at].count("(") > text[begin:at].count(")") and text[at : at + 1] == ")")
                license_id, score = self.named(text[begin:close])
                if score and (best is None or (score, close) > best[:2]):
                    best = score, close, license_id
            at = _BETWEEN.match(text, at).end()
        return (best[2], best[1]) if best else None

    def _choice_at(self, text: str, at: int, joint: re.Pattern = _OR) -> tuple[Choice, int] | None:
        found, ids = self.name_at(text, at), []
        while found:
            ids.append(found[0])
            at = found[1]
            m = joint.match(text, at)
            found = self.name_at(text, m.end()) if m else None
        return (frozenset(x for x in ids if x), at) if ids else None

    def _wording(self, text: str) -> set[Choice]:
        words = _WORD.findall(_OWNER_LINE.sub(" ", text).lower())
        if len(words) < 4:
            return set()
        pairs = list(zip(words, words[1:]))
        shared = Counter(t for p in set(pairs) for t in self.of_bigram.get(p, ()))
        out = set()
        for t, n in shared.items():
            license_id, length, template = self.templates[t]
            if 2 * n < self.dice * len(template):  # no stretch of the text can reach the threshold
                continue
            hits = [i for i, p in enumerate(pairs) if p in template]
            score = 0.0
            for first in hits:
                for size in (length, len(pairs) if len(pairs) < length else 0, int(length * 1.15)):
                    piece = set(pairs[first : first + size]) if size else set()
                    if piece:
                        score = max(score, 2 * len(piece & template) / (len(piece) + len(template)))
                if score >= 0.95:
                    break
            if score >= self.dice:
                out.add(frozenset([license_id]))
        return out

    def _statements(self, text: str, license_file: bool) -> frozenset[Choice]:
        out: set[Choice] = set()
        lines = text.split("\n")
        joined = " ".join(" ".join(lines).split())
        for m in _TAG.finditer(joined):
            at = m.end()
            while found := self._choice_at(joined, at):
                out.add(found[0])
                more = _AND.match(joined, found[1])
                if not more:
                    break
                at = more.end()
        for sentence in _SENTENCE.split(joined):
            if _NO_GRANT.search(sentence):
                continue
            if m := _EITHER.search(sentence):
                first = _BULLET.match(sentence, m.end())
                if found := self._choice_at(sentence, first.end() if first else m.end(), _BULLET):
                    out.add(found[0])
                continue
            grant = _GRANT.search(sentence)
            for m in _UNDER.finditer(sentence, grant.end()) if grant else ():
                if found := self._choice_at(sentence, m.end()):
                    out.add(found[0])
                    break  # what follows are the other members of the choice
        if license_file and not _EITHER.search(joined):
            for line in lines:
                line = line.strip(" \t#*=-.")
                if line and (found := self.name_at(line, 0)) and found[1] >= len(line):
                    out.add(frozenset([found[0]]) if found[0] else frozenset())
        out |= self._wording(text)
        return frozenset(x for x in out if x)


def verdict(statements: list[list[str]]) -> str:
    """The licence on which all statements agree, 'conflict' or 'unknown'."""
    if not statements:
        return "unknown"
    common = set.intersection(*(set(s) for s in statements))
    return " OR ".join(sorted(common)) if common else "conflict"


def reader(license_refs: DataFrame, dice: float = DICE) -> Reader:
    """Reader from the reference table, which must be small: its size is checked first."""
    size = license_refs.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in ("license_id", "title", "notice", "body")))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"licence templates of {size} characters; at most {TEMPLATE_BYTES} are sent to every task")
    rows = license_refs.select("license_id", "title", "notice", "body").where("license_id is not null").distinct().collect()
    return Reader(sorted((r[0], r[1] or "", r[2] or "", r[3] or "") for r in rows), dice)


def folder(relpath: Column) -> Column:
    """Directory part of a path; '' for the root."""
    return F.regexp_replace(relpath, r"/?[^/]*$", "")


def read_statements(files: DataFrame, refs: Reader) -> DataFrame:
    """project, relpath, is_license, statements (array of arrays of licence ids) for every file.

    Of a source file only the opening comment is read, of a licence file all of it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.string()))
        for part in parts:
            said = []
            for path, data in zip(part.column("relpath").to_pylist(), part.column("bytes")):
                data = data.as_py() or b""
                if path.rsplit("/", 1)[-1] in LICENSE_FILE_NAMES:
                    text = data.decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
                    found = refs.statements(text, True)
                else:
                    found = refs.statements(comment_text(opening_comment(data, suffix(path))[0]), False)
                said.append(sorted(sorted(x) for x in found))
            yield pa.RecordBatch.from_arrays([part.column("project"), part.column("relpath"), pa.array(said, kind)], ["project", "relpath", "statements"])

    out = files.select("project", "relpath", "bytes").where("project is not null and relpath is not null").mapInArrow(run, "project string, relpath string, statements array<array<string>>")
    return out.withColumn("is_license", file_name(F.col("relpath")).isin(*LICENSE_FILE_NAMES))


def licenses(files: DataFrame, sources: DataFrame, license_refs: DataFrame, dice: float = DICE) -> DataFrame:
    """project, relpath, license for each source file, and with relpath '' for each project.

    Statements that apply to a file: those of its opening comment and those of the nearest folder
    at or above its own whose licence files state something; to a project: those of its root.
    A null project or path names no file and gives no row; empty files and folders without any
    statement give 'unknown'; repeated rows count once; extra columns are ignored.
    """
    # Three branches read the statements; the table spares two more scans of all file contents.
    read = cut_lineage(read_statements(files, reader(license_refs, dice)))
    union = F.array_distinct(F.flatten(F.collect_set("statements")))  # repeated rows combine before the shuffle
    own = read.where("not is_license").groupBy("project", "relpath").agg(union.alias("statements"))
    own = own.withColumn("dir", folder(F.col("relpath")))
    # Licence files are few and small; one row a folder after this.
    stated = (
        read.where("is_license and size(statements) > 0")
        .withColumn("dir", folder(F.col("relpath")))
        .groupBy("project", "dir")
        .agg(union.alias("stated"))
    )
    # Every folder with sources looks through its ancestors once, however many files it holds.
    steps = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))
    )
    dirs = read.where("not is_license").select("project", folder(F.col("relpath")).alias("dir")).distinct()
    nearest = (
        dirs.select("project", "dir", F.explode(steps).alias("up"))
        .join(stated.withColumnRenamed("dir", "up"), ["project", "up"])
        .groupBy("project", "dir")
        .agg(F.max_by("stated", F.length("up")).alias("stated"))
    )
    applied = own.join(nearest, ["project", "dir"], "left").select("project", "relpath", F.concat("statements", F.coalesce("stated", F.array().cast("array<array<string>>"))).alias("s"))
    roots = (
        sources.select("project").where("project is not null").distinct()
        .join(stated.where("dir = ''"), "project", "left")
        .select("project", F.lit("").alias("relpath"), F.coalesce("stated", F.array().cast("array<array<string>>")).alias("s"))
    )
    common = F.array_sort(F.aggregate(F.slice("s", 2, 1 << 30), F.element_at("s", 1), lambda a, b: F.array_intersect(a, b)))
    license_ = F.when(F.size("s") == 0, "unknown").when(F.size(common) == 0, "conflict").otherwise(F.array_join(common, " OR "))
    return applied.unionByName(roots).select("project", "relpath", license_.alias("license"))
