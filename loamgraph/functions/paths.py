"""Path columns: names, extensions, directories, canonical and relative forms. All are built-in expressions."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, case kept; empty for names without one or with only a leading one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension(path)))


def top_directory(path: Column) -> Column:
    """First segment, empty for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """All directories above the path, outermost first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def canonical(path: Column, decode: bool = False) -> Column:
    """No leading slash before a drive letter, forward slashes, no quotes, single slashes, no trailing slash. decode: percent escapes first (needs Python)."""
    p = path
    if decode:
        p = F.pandas_udf(lambda s: s.map(lambda x: unquote(x) if x is not None else None), "string")(path)
    p = F.regexp_replace(p, r"^/([A-Za-z]:)", "$1")
    p = F.regexp_replace(F.translate(p, '\\"', "/"), "/+", "/")
    return F.regexp_replace(p, "/$", "")


def resolved(path: Column) -> Column:
    """Without . and .. segments; .. above the start of the path is kept."""
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    step = lambda acc, x: F.when((x == "..") & F.coalesce(F.when(F.size(acc) > 0, up(acc)), F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, empty, step), "/"))


def relative(path: Column, root: str) -> Column:
    """Path below root; null outside it."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).when(path == root.rstrip("/"), "")


def absolute(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def package_of(specifier: Column) -> Column:
    """Package name of an import: after the last node_modules, two segments for scoped names, else one."""
    rest = F.when(F.instr(specifier, "node_modules/") > 0, F.substring_index(specifier, "node_modules/", -1)).otherwise(specifier)
    return F.when(F.startswith(rest, F.lit("@")), F.regexp_extract(rest, r"^(@[^/]+/[^/]+|@[^/]+)", 1)).otherwise(F.substring_index(rest, "/", 1))


def scope_of(package: Column) -> Column:
    return F.when(F.startswith(package, F.lit("@")), F.substring_index(package, "/", 1))


def glob_pattern(glob: str) -> str:
    """A glob as a case-insensitive regular expression: any directory may stand before it, * and ? stay in a segment, ** spans them."""
    out, i = [], 0
    if glob.startswith("**/"):
        glob = glob[3:]
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        out.append({"*": r"[^/\\]*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?i)^(?:.*/)?" + "".join(out) + "$"


def excluded(path: Column, globs: tuple[str, ...] = ()) -> Column:
    """Under version control or node_modules, a private file, or matched by a glob (those with /*. also by name)."""
    hit = F.contains(path, F.lit(".git")) | F.contains(path, F.lit("node_modules")) | F.startswith(basename(path), F.lit(".loamgraph"))
    if globs:
        hit = hit | path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
        names = [g for g in globs if "/*." in g]
        if names:
            hit = hit | basename(path).rlike("|".join(f"(?:{glob_pattern(g)})" for g in names))
    return hit


def ignored(path: Column, rules: list[str], is_directory: Column | None = None) -> Column:
    """Ignore-file rules in order, the last that matches wins; ! re-includes, a trailing slash means directories, an inner slash anchors."""
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule
        only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body = "".join({"*": "[^/]*", "?": "[^/]"}.get(x, ".*" if x == "**" else re.escape(x)) for x in re.findall(r"\*\*|.", rule.lstrip("/")))
        below = "/.*" if only_dirs else "(?:/.*)?"
        hit = path.rlike(("^" if anchored else "^(?:.*/)?") + body + below + "$")
        if only_dirs and is_directory is not None:
            hit = hit | (is_directory & path.rlike(("^" if anchored else "^(?:.*/)?") + body + "$"))
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out
