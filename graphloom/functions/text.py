"""Column functions over names, paths and texts; a few also for single values on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that may call each other by bare name (fixed values).
FAMILIES = (("javascript", "typescript", "tsx"),)
TEST_FILE = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.[^/.]+$|\.(test|spec)\.[^/.]+$"
TEST_COMMUNITY = r"(?i)(^|[-_/])(tests?|spec|specs)([-_/]|$)"
COMMON_SEGMENTS = ("home", "src", "lib", "app", "users", "usr")


def language_family(language: str) -> list[str]:
    return next((list(f) for f in FAMILIES if language in f), [language])


def sanitize_name(s: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F]", ""), 1, most)


def qualified(kind: Column, path: Column, parent: Column, name: Column, identity: Column | None = None) -> Column:
    """The path of a File, path::name, or path::Parent.name."""
    own = name if identity is None else F.coalesce(identity, name)
    return F.when(kind == "File", path).when(parent.isNotNull(), F.concat(path, F.lit("::"), parent, F.lit("."), own)).otherwise(F.concat(path, F.lit("::"), own))


def bridge_name(name: Column) -> Column:
    """Forward slashes in what stands before the first `::`."""
    at = F.locate("::", name)
    head = F.when(at > 0, name.substr(F.lit(1), at - 1)).otherwise(name)
    return F.when(at > 0, F.concat(F.replace(head, F.lit("\\"), F.lit("/")), name.substr(at, F.length(name)))).otherwise(F.replace(head, F.lit("\\"), F.lit("/")))


def file_of(name: Column) -> Column:
    return F.substring_index(name, "::", 1)


def split_name(name: Column) -> Column:
    """Words of a camel- or snake-case name, lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), r"[_\-.\s]+"), lambda w: w != "")


def split_identifier(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, r"[_\-.\s]+", " "))


def to_slug(s: Column, most: int = 30) -> Column:
    dashed = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.length(dashed) <= most, dashed).otherwise(F.regexp_replace(F.substring(dashed, 1, most), "-[^-]*$", ""))


def wiki_slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\w\s-]", ""), r"[\s_]+", "-"), F.lit("-"))


def parent_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def path_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: (F.length(s) >= 4) & ~F.lower(s).isin(*COMMON_SEGMENTS))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_test_community(name: Column) -> Column:
    return name.rlike(TEST_COMMUNITY)


def estimate_tokens(text: Column) -> Column:
    """ceil(length / 4), 0 for nothing."""
    return F.when(F.length(text) > 0, F.ceil(F.length(text) / 4)).otherwise(0).cast("long")


def floor_tokens(text: Column) -> Column:
    """The corpus benchmark's estimate: at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def context_savings(before: Column, after: Column) -> Column:
    saved = F.greatest(F.lit(0), before - after)
    return F.struct(saved.alias("saved"), F.when(before > 0, F.bround(100 * saved / before)).otherwise(0).cast("long").alias("percent"))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def query_identifiers(text: Column) -> Column:
    """Dotted, snake- and Pascal-case tokens of a question, lower case, of three characters or more."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", r"\b[a-zA-Z]\w*_\w+\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b")]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), F.lower), lambda t: F.length(t) >= 3))


def cypher_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def config_key(key: Column) -> Column:
    """A property key in its canonical form: lower case, camel case and underscores as dashes, indexes without brackets."""
    dashed = F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1-$2"), "_", "-")
    return F.trim(F.lower(F.regexp_replace(dashed, r"\[(\w+)\]", ".$1")), F.lit("."))


def is_config_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(r"^(application|bootstrap)(-[\w.-]+)?\.(properties|ya?ml)$")


def ends_with_path(tokens: Column, suffix: Column) -> Column:
    n = F.size(suffix)
    return (F.size(tokens) >= n) & (F.slice(tokens, F.size(tokens) - n + 1, n) == suffix)


def scoped_parts(target: Column, language: Column) -> Column:
    """(scope, method) of Class::method as its language writes it; null where it isn't one."""
    two = F.split(target, "::")
    ok = F.when(language == "rust", F.size(two) == 2).otherwise(F.size(two) >= 2) & ~((language == "php") & (F.lower(two[0]) == "parent")) & (two[0] != "self")
    return F.when(ok, F.struct(F.array_join(F.slice(two, 1, F.size(two) - 1), "::").alias("scope"), F.element_at(two, -1).alias("method")))


def looks_like_java_method(target: Column) -> Column:
    return target.rlike(r"^[a-z]\w*(\.[a-z]\w*)*\.[A-Z]\w*\.[a-zA-Z_]\w*(\(.*\))?$")


def node_text(name: Column, kind: Column, parent: Column, params: Column, returns: Column, language: Column) -> Column:
    """What is searched and embedded for a node."""
    return F.concat_ws(" ", split_identifier(name), F.when(kind != "File", F.lower(kind)), F.when(parent.isNotNull(), F.concat(F.lit("in "), parent)), params, F.when(returns.isNotNull(), F.concat(F.lit("returns "), returns)), language)


def glob_regex(pattern: str) -> str:
    """A file-name glob as a regular expression over whole paths."""
    out = ""
    for part in re.split(r"(\*\*?|\?|\[[^\]]*\])", pattern):
        out += {"*": "[^\x00]*", "**": "[^\x00]*", "?": "."}.get(part) or (("[" + part[1:-1].replace("!", "^", 1) + "]") if part[:1] == "[" and part[-1:] == "]" else re.escape(part))
    return f"^{out}$"
