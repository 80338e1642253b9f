"""Column expressions over names, paths and texts.

Cases: a null argument gives null (predicates: null, which no filter lets through); the empty text
has no n-grams, hashes or tokens, and an empty name has no extension.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by class.
DATA_EXTENSIONS = (".json", ".txt", ".md", ".png", ".jpg", ".jpeg", ".gif", ".xml", ".yml", ".yaml", ".html", ".css", ".svg", ".csv", ".ini")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif")
CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".kt", ".c", ".h", ".cpp", ".go", ".rs")


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """A short id that depends on the parts alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9_]+)$", 1))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what isn't UTF-8 is left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\ufffd", "")


def file_class(path: Column) -> Column:
    """tree for code, weed for data and prose, else other."""
    ext = extension(path)
    return F.when(ext.isin(*CODE_EXTENSIONS), "tree").when(ext.isin(*DATA_EXTENSIONS), "weed").otherwise("other")


def module_name(path: Column) -> Column:
    """a/b/__init__.py and a/b.py are the module a.b."""
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9_]+$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"\.__init__$", "")


def glob_regex(pattern: str) -> str:
    """The regular expression of an ignore pattern: * and ? within a segment, ** for any
    number of segments; a pattern without / fits any segment."""
    segments = [s for s in pattern.strip("/").split("/") if s]
    one = lambda s: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
    if len(segments) == 1 and segments[0] != "**":
        return f"(^|/){one(segments[0])}(/|$)"
    body = "".join("([^/]+/)*" if s == "**" else one(s) + "/" for s in segments)
    return f"^{body.removesuffix('/')}(/|$)" if body.endswith("/") else f"^{body}"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits; comments and negations are no patterns."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and p[0] not in "#!":
            out = out | path.rlike(glob_regex(p.strip()))
    return out


def normalized_identifier(name: Column) -> Column:
    """camelCase, XMLParser and kebab-case as snake_case; other characters as they are."""
    acronyms = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    split = F.regexp_replace(acronyms, "([a-z0-9])([A-Z])", "$1_$2")
    return F.translate(F.lower(split), "-", "_")


def module_paths(module: Column) -> Column:
    """The paths that a module may have, likeliest first: the inverse of module_name()."""
    base = F.replace(F.regexp_replace(module, r"\.py$", ""), F.lit("."), F.lit("/"))
    ends = [".py", "/__init__.py", *(x for e in (".js", ".ts", ".java", ".go", ".c", ".h", ".cpp") for x in (e, f"/index{e}"))]
    return F.array(*[F.concat(base, F.lit(e)) for e in ends])


def identifier_tokens(name: Column) -> Column:
    return F.filter(F.split(normalized_identifier(name), "_"), lambda t: t != "")


def ngrams(text: Column, n: int = 3) -> Column:
    """All runs of n characters of the lower-cased text, in order. The characters are taken
    apart once and zipped with themselves, which is linear in the text's length."""
    chars = F.split(F.lower(text), "")

    def runs(c: Column) -> Column:
        out = c
        for k in range(1, n):
            out = F.zip_with(out, F.slice(c, k + 1, 1 << 30), lambda x, y: F.concat(x, y))
        return F.filter(out, lambda x: x.isNotNull())

    return F.get(F.transform(F.array(chars), runs), F.lit(0))


def word_grams(text: Column) -> Column:
    """The 3-grams of a text that have a letter or digit."""
    return F.filter(ngrams(text), lambda g: g.rlike("[A-Za-z0-9一-鿿]"))


def gram_hashes(text: Column, limit: int | None = 300) -> Column:
    """Distinct short hashes of the first ``limit`` 3-grams with a letter or digit (None: all)."""
    if limit:
        grams = F.slice(word_grams(text), 1, limit)
    else:  # of a whole text, each gram is looked at and hashed once
        grams = F.filter(F.array_distinct(ngrams(text)), lambda g: g.rlike("[A-Za-z0-9一-鿿]"))
    return F.array_distinct(F.transform(grams, lambda g: F.substring(F.sha1(g), 1, 6)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def content_fingerprint(content: Column, size: Column) -> Column:
    """Of a file's first 4096 bytes and its size."""
    return F.substring(F.sha1(F.concat(F.substring(content, 1, 4096), size.cast("string").cast("binary"))), 1, 12)


def line_number(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, most: int = 100) -> Column:
    return F.substring(text, 1, most)
