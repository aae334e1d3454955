"""Scalar text functions, all inside code generation: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the reference runtime takes for white space: Unicode spaces, vertical tab and the byte-order mark.
WIDE_SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PLAIN_SPACE = r"[\t\n\f\r ]"


def hash_text(x: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def collapse_spaces(x: Column, space: str = WIDE_SPACE) -> Column:
    """Runs of white space as one blank, without outer ones."""
    return F.btrim(F.regexp_replace(x, space + "+", " "), F.lit(" "))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))


_LITERALS = (r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'", r"`(?:[^`\\]|\\.)*`")


def _literals_out(x: Column) -> Column:
    for pattern in _LITERALS:
        x = F.regexp_replace(x, pattern, '"__STR__"')
    return F.regexp_replace(x, r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])", "__NUM__")


def normalize_body(body: Column, params: Column) -> Column:
    """Token text with literals, parameters (by place) and member-access objects made neutral.

    params is an array of names. Word borders are ASCII; $ is escaped wherever it
    stands in a replacement.
    """
    numbered = F.transform(params, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    escaped = lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # A parameter's name may begin or end with a sign such as $, where no word border can be.
    edge = lambda p: F.concat(F.when(p.rlike(r"^[A-Za-z0-9_]"), r"(?<![A-Za-z0-9_])").otherwise(r"(?<=[A-Za-z0-9_])"), escaped(p), F.when(p.rlike(r"[A-Za-z0-9_]$"), r"(?![A-Za-z0-9_])").otherwise(r"(?=[A-Za-z0-9_])"))
    placed = F.aggregate(numbered, _literals_out(body), lambda acc, x: F.regexp_replace(acc, edge(x["p"]), F.concat(F.lit("\\$"), x["i"].cast("string"))))
    neutral = F.regexp_replace(placed, r"(?<![A-Za-z0-9_])this\s*\.\s*", r"\$_.")
    return collapse_spaces(F.regexp_replace(neutral, r"\$\d+\s*\.\s*", r"\$_."))


def normalize_tokens(tokens: Column) -> Column:
    """Token text with literals made neutral; used for its length only."""
    return F.regexp_replace(_literals_out(tokens), r"(?<![A-Za-z0-9_])this\.", r"\$_.")


def analyze_body(tokens: Column, params: Column) -> dict[str, Column]:
    """hash, normalized_hash, body_len and norm_body_len of a function body's token text."""
    norm = normalize_body(tokens, params)
    return {"hash": hash_text(tokens), "normalized_hash": hash_text(norm), "body_len": utf16_length(tokens), "norm_body_len": utf16_length(norm)}


def name_segments(name: Column) -> Column:
    """The distinct lower-case parts of a name, cut at underscores and between a small and a capital letter."""
    parts = F.split(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"), "_")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), F.lower))


def shape_key(names: Column) -> Column:
    """Sorted property names joined by NUL."""
    return F.array_join(F.array_sort(names), "\x00")


def literal_arg(arg: Column) -> Column:
    """The text of a value-stable literal argument (struct kind, text), else null; undefined is none."""
    return F.when(arg["kind"].isin("string", "template", "number", "negative", "true", "false", "null"), arg["text"])


def export_key(file: Column, name: Column) -> Column:
    return F.struct(file.alias("file"), name.alias("name"))


def is_entry_point(file: Column) -> Column:
    return file.rlike(r"(^|/)index\.[cm]?[jt]sx?$") | file.contains("/bin/")


def line_of(source: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(source, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def clean_block_comment(value: Column) -> Column:
    """Lines of a block comment without their stars and outer blanks, empty ones dropped."""
    lines = F.transform(F.split(value, "\n"), lambda l: F.trim(F.regexp_replace(F.trim(l), r"^\*+\s?", "")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def split_list(value: Column) -> Column:
    """Comma-separated parts, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda p: p != "")


def wildcard(pattern: Column) -> Column:
    """A pattern with * as an anchored regular expression."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def relative_path(file: Column, root: str) -> Column:
    """Path below root with forward slashes; other paths begin with ../"""
    base = root.rstrip("/") + "/"
    slashed = F.replace(file, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(base), F.substring(slashed, len(base) + 1, 1 << 30)).otherwise(F.concat(F.lit("../"), slashed))


def script_kind(file: Column) -> Column:
    """Parser mode by extension."""
    low = F.lower(file)
    return F.when(low.endswith(".tsx"), "tsx").when(low.endswith(".jsx"), "jsx").when(low.rlike(r"\.[cm]?ts$"), "ts").when(low.rlike(r"\.[cm]?js$"), "js").otherwise("ts")


#: Extensions tried for a relative import: (usage resolution, link detection).
USAGE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts")
LINK_EXTENSIONS = (*USAGE_EXTENSIONS, ".mjs", ".cjs")


def resolve_relative(file: Column, specifier: Column) -> Column:
    """The path a relative specifier points at from a file, with . and .. folded."""
    folder = F.split(F.regexp_replace(file, r"/[^/]*$", ""), "/")
    parts = F.concat(folder, F.split(specifier, "/"))
    fold = lambda acc, p: F.when(p.isin(".", ""), F.when((p == "") & (F.size(acc) == 0), F.array(p)).otherwise(acc)).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def module_candidates(base: Column, extensions: tuple[str, ...] = USAGE_EXTENSIONS) -> Column:
    """(path, priority) of every file that a resolved specifier may mean, the first that exists wins; a .js specifier may mean a .ts file."""
    stem = F.regexp_replace(base, r"\.([cm]?)jsx?$", "")
    paths = [base, *[F.concat(base, F.lit(e)) for e in extensions], *[F.concat(base, F.lit("/index" + e)) for e in extensions], *[F.concat(stem, F.lit(e)) for e in extensions]]
    return F.array(*[F.struct(p.alias("path"), F.lit(i).alias("priority")) for i, p in enumerate(paths)])
