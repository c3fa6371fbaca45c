"""What the head of a file says about where it comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and names of files that are compared, and of licence files.
TEXT_SUFFIXES = (
    "c cc cp cpp cxx c++ C h hh hpp H f f90 f95 f03 f08 for fpp go py sh awk exp inc def json sarif rs d di m mm tcc ipp S s"
).split()
SKIP_NAMES = ("ChangeLog", "README", "README.compat", "README.libquadmath", "README.gcc", "README.gnat")
LICENSE_NAMES = ("LICENSE", "LICENSE.txt", "LICENSE.md", "license.txt", "COPYING", "COPYING3", "COPYRIGHT")
# Markers whose presence makes a file a candidate.
CANDIDATE_MARKERS = (
    "Copied from", "copied from", "Adapted from", "adapted from", "Derived from", "derived from", "Based on", "based on", "SPDX-",
    "Copyright", "copyright", "license", "License", "The Go Authors", "OpenMP", "OpenACC", "LAPACK", "BLAS", "SARIF", "sollve_vv",
)
# Wording of provenance in a header.
SPDX = r"(?i)SPDX-(?:File|Snippet|License)"
ORIGIN = r"(?i)(?:^|[^A-Za-z0-9_])(?:copied|adapted|derived|based)(?:[^A-Za-z0-9_\n][^\n]{0,78}[^A-Za-z0-9_\n]|[^A-Za-z0-9_\n])(?:from|on)(?:$|[^A-Za-z0-9_])"
CANONICAL = r"(?i)canonical\s+source\s+of\s+this\s+file\s+is\s+maintained\s+with(?:$|[^A-Za-z0-9_])"
URL_TAIL = r"(?i)(?:https?://|git://|git@)[^\n]{0,74}"
HOST_SITES = r"(?i)gnu\.org/licenses|www\.gnu\.org|fsf\.org|gcc\.gnu\.org"
INLINE_LICENSES = (
    "redistribution and use in source and binary forms", "permission to use, copy, modify, and distribute this",
    "this software is provided 'as-is'", 'this software is provided "as is"', "see copyright notice in",
)
HOLDER = r"(?i)copyright\s*(?:\([cC]\))?\s*([^\n]+)"
PART_OF = r"(?i)part of the\s+([^\n\r,.;]+?)\s+(?:library|project|compiler|runtime|suite)"
# Names of the host project, by which a file that is "part of" something isn't from elsewhere.
HOST_TERMS = (
    "gcc", "libiberty", "libquadmath", "libstdc++", "libgomp", "libgfortran", "libobjc", "libbacktrace", "libcpp", "libgrust", "libsanitizer",
    "gnu compiler collection",
)
# Mentions by which an upstream file, and a downstream one, attributes code to the host project.
ATTRIBUTIONS = (
    r"\bGCC\b", r"(?i)GNU\s+Compiler\s+Collection", r"(?i)Free\s+Software\s+Foundation", r"(?i)Runtime\s+Library\s+Exception", r"\blibgcc\b",
    r"(?i)\blibstdc\+\+\b", r"\blibgomp\b", r"\blibgfortran\b", r"\blibquadmath\b", r"\blibiberty\b", r"(?i)\blibsupc\+\+", r"\blibobjc\b",
    r"\blibitm\b", r"\blibatomic\b", r"\blibbacktrace\b", r"\blibssp\b", r"\blibvtv\b", r"(?i)kept\s+in\s+sync\s+with\s+libgcc",
    r"(?i)\bgcc\.gnu\.org", r"(?i)sourceware\.org/gcc",
)
DOWNSTREAM_ATTRIBUTIONS = (
    r"\bGCC\b", r"(?i)GNU\s+Compiler\s+Collection", r"(?i)Free\s+Software\s+Foundation", r"(?i)Runtime\s+Library\s+Exception", r"\blibgcc\b",
    r"(?i)\blibstdc\+\+\b", r"\blibgomp\b", r"\blibgfortran\b", r"\blibobjc\b", r"\blibquadmath\b", r"\blibiberty\b", r"(?i)\blibsupc\+\+",
    r"(?i)kept\s+in\s+sync\s+with\s+libgcc", r"(?i)gcc\.gnu\.org", r"(?i)sourceware\.org/gcc",
)
# Patterns of secrets, of scraped pages, of status in free text, of a header without suffix, of a mention of tools.
SECRETS = r"(?i)(api[_-]?key|api[_-]?token|secret[_-]?key|password\s*=|BEGIN (RSA|OPENSSH|PGP|EC) PRIVATE|ghp_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,})"
SCRAPED = r"attachment-[0-9]{3,}|Log out [^ ]+@"
STATUS_LIKE = r"RESOLVED FIXED|merged on trunk; BZ|BZ still `NEW`|Patch on Bugzilla|attachment-[0-9]{3,}"
HEADER_LIKE = r"(?m)^\s*(#|//|/\*|namespace|template|class|struct|inline|constexpr|typedef|using|enum)"
TOOL_MENTION = r"\b(AI|LLM)\b|Assisted-by"
# An origin inside the host project, the host's own licence, and markers of an origin elsewhere.
INTERNAL = r"(?i)(?:copied|adapted|derived|based)[^\n]{0,120}(?:gcc/testsuite/|libgomp/testsuite/|gfortran\.dg/|libgomp\.|['\"]\.\.?/|\.\./|\./)"
GNU = r"(?i)gnu\.org/licenses|Free Software Foundation"
# Points of origin markers in a header.
ORIGIN_POINTS = {
    "go authors": 85, "lapack": 55, "blas": 50, "sollve_vv": 45, "sarif": 35, "json example": 30, "specification": 25, "example document": 30,
}
EXTERNAL_MARKERS = ("The Go Authors", "LAPACK", "BLAS", "SARIF", "sollve_vv")


def is_text_candidate(path: Column) -> Column:
    """Source files by name: suffix in the list, not a change log, a readme, a licence or a patch."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    skip = name.isin(*SKIP_NAMES, *LICENSE_NAMES) | name.startswith("ChangeLog") | name.endswith(".patch")
    return ~skip & (suffix.isin(*TEXT_SUFFIXES) | name.endswith(".exp"))


def has_candidate_marker(text: Column) -> Column:
    found = F.lit(False)
    for m in CANDIDATE_MARKERS:
        found = found | F.contains(text, F.lit(m))
    return found


def _first(low: Column, names: dict[str, str]) -> Column:
    """The name of the first phrase that the text contains, null without any."""
    out = F.lit(None).cast("string")
    for phrase, name in reversed(names.items()):
        out = F.when(F.contains(low, F.lit(phrase)), name).otherwise(out)
    return out


def evidence(header: Column) -> Column:
    """Ordered names of the provenance markers of a header; an empty array makes it silent."""
    low = F.lower(header)
    url = F.filter(F.regexp_extract_all(header, F.lit(URL_TAIL), F.lit(0)), lambda u: ~u.rlike(HOST_SITES))
    holder = F.filter(F.regexp_extract_all(header, F.lit(HOLDER), F.lit(1)), lambda h: (F.trim(h) != "") & ~F.lower(h).contains("free software foundation") & ~(F.lower(h).contains("gnu") & F.lower(h).contains("org")))
    inline = _first(low, {p: f"inline-license:{p[:24]}" for p in INLINE_LICENSES})
    marker = _first(low, {m.lower(): f"external-marker:{m}" for m in EXTERNAL_MARKERS})
    part = F.trim(F.regexp_extract(header, PART_OF, 1))
    host = F.lit(False)
    for term in HOST_TERMS:
        host = host | F.contains(F.lower(part), F.lit(term))
    return F.array_compact(
        F.array(
            F.when(header.rlike(SPDX), "SPDX"),
            F.when(header.rlike(ORIGIN), "origin-phrase"),
            F.when(header.rlike(CANONICAL), "canonical-source"),
            F.when(F.size(url) > 0, "external-url"),
            inline,
            marker,
            F.when(F.size(holder) > 0, F.concat(F.lit("copyright:"), F.trim(F.substring(F.trim(holder[0]), 1, 40)))),
            F.when((part != "") & ~host, F.concat(F.lit("part-of:"), F.substring(part, 1, 48))),
        )
    )


def attributed(text: Column, patterns: tuple[str, ...] = ATTRIBUTIONS) -> Column:
    """Whether a text names the host project."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def clone_language(path: Column) -> Column:
    """Grammar for clone detection by suffix."""
    s = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(s == "rs", "rust").when(s == "go", "go").when(s == "py", "python").when(s.isin("f", "f90", "f95", "f03", "f08", "for", "fpp"), "fortran").otherwise("cpp")


def snippet_quality(line: Column) -> Column:
    """How well a line serves as a search phrase: its length and variety, -1 if it doesn't."""
    bare = F.trim(line)
    low = F.lower(bare)
    # Beginnings and phrases that make a line useless.
    bad = F.lit(False)
    for b in ("/*", "*", "//", "#", "! { dg-", "// { dg-", "/* { dg-"):
        bad = bad | bare.startswith(b)
    for p in (
        "all rights reserved", "redistribution and use in source and binary forms", "this software is provided",
        "notice, this list of conditions and the following disclaimer", "permission is hereby granted", "the above copyright notice",
        "without specific prior written permission", "free software foundation",
    ):
        bad = bad | F.contains(low, F.lit(p))
    length = F.length(line)
    letters = F.length(F.regexp_replace(line, r"[^A-Za-z]", ""))
    variety = F.size(F.array_distinct(F.split(bare, "")))
    return F.when((length < 24) | (length > 180) | (letters < 12) | bad, -1).otherwise(variety + F.length(bare))


def header_points(header: Column, nearby: Column, tree: Column, kind: Column, local: Column) -> Column:
    """Reasons with their points, in order, why a header and what lies around a file give it an origin elsewhere.

    ``nearby``: a licence file in the file's folder or above; ``tree``: one in the project's root;
    ``kind``: of the review entry that matches the file, null without one; ``local``: added here.
    """
    low = F.lower(header)
    has = lambda phrase: F.contains(low, F.lit(phrase))
    yes = lambda c: F.coalesce(c, F.lit(False))
    holder = F.filter(F.regexp_extract_all(header, F.lit(HOLDER), F.lit(1)), lambda h: (F.trim(h) != "") & ~F.lower(h).contains("free software foundation") & ~(F.lower(h).contains("gnu") & F.lower(h).contains("org")))
    spdx, gnu, origin = header.rlike(SPDX), header.rlike(GNU), header.rlike(ORIGIN)
    trail = spdx | gnu | has("license") | nearby | tree
    marker = F.lit(False)
    for m in EXTERNAL_MARKERS:
        marker = marker | has(m.lower())
    inline = F.lit(False)
    for p in INLINE_LICENSES:
        inline = inline | has(p)
    rules = [
        (yes(kind.isNotNull()), -20, "reviewed"),
        (yes(kind == "false_positive"), -1000, "false-positive"),
        (yes((kind == "accepted_external") & ~local), -1000, "accepted-inherited"),
        (yes(kind == "accepted_external"), -60, "accepted"),
        (yes(kind == "project_policy"), -1000, "policy"),
        (yes(kind == "needs_local_license"), 15, "needs-license"),
        (spdx, -35, "spdx"), (gnu, -30, "gnu-header"), (nearby, -20, "licence-near"), (tree & ~nearby, -15, "licence-in-tree"),
        (origin & header.rlike(INTERNAL), -35, "origin-inside"), (origin & ~header.rlike(INTERNAL), 55, "origin-outside"),
        *((has(m), n, f"marker:{m}") for m, n in ORIGIN_POINTS.items()),
        (has("license that can be found in the license file") & tree, -35, "licence-file-there"), (has("license that can be found in the license file") & ~tree, 35, "licence-file-missing"),
        (has("all rights reserved") & trail, -10, "rights-with-trail"), (has("all rights reserved") & ~trail, 20, "rights-reserved"),
        (has("bsd-style") & tree, -20, "bsd-with-trail"), (has("bsd-style") & ~tree, 20, "bsd-style"),
        ((F.size(holder) > 0) & trail, 20, "holder-with-trail"), ((F.size(holder) > 0) & ~trail, 70, "holder"),
        (marker & tree, -20, "external-with-trail"), (marker & ~tree & ~nearby, 15, "external"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("points"), F.lit(r).alias("reason"))) for c, p, r in rules)))
    total = F.aggregate(found, F.lit(0), lambda acc, x: acc + x["points"])
    more = F.array_compact(
        F.array(
            F.when(local & (total > 0), F.struct(F.lit(20).alias("points"), F.lit("local").alias("reason"))),
            F.when(~local & trail & inline, F.struct(F.lit(-1000).alias("points"), F.lit("inherited").alias("reason"))),
        )
    )
    return F.concat(found, more)


#: Reasons that take a file off the report.
SUPPRESSING = ("false-positive", "accepted-inherited", "policy", "inherited")
