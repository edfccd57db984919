"""Scores of files: importance, search ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension, stem, top_directory

# Points of extensions, names and places.
POINTS = {3: ".ts .tsx", 2: ".js .jsx .mjs .cjs .php .go .rb .py .c .cpp .cc .cxx .h .hpp .hh .hxx", 1: ".sh .sql"}
MANIFESTS = ("package", "tsconfig", "composer")
SIGNIFICANT = "index main server app config types utils kernel provider middleware service repository controller model layout master platformio cmakelists makefile".split()


def base_importance(path: Column) -> Column:
    """0 to 10 from the path alone."""
    ext, name = extension(path), stem(path)
    points = F.lit(0)
    for n, exts in POINTS.items():
        points = F.when(ext.isin(*exts.split()), n).otherwise(points)
    points = F.when(ext == ".json", F.when(name.isin(*MANIFESTS), 3).otherwise(1)).when(ext == ".md", F.when(F.lower(name) == "readme", 2).otherwise(1)).when(ext == ".mod", F.when(name == "go", 3).otherwise(1)).otherwise(points)
    top = top_directory(path)
    points = points + F.when(name == "Gemfile", 3).otherwise(0)
    points = points + F.when(top.isin("src", "app"), 2).when(top.isin("test", "tests"), 1).otherwise(0)
    points = points + F.when(F.lower(name).isin(*SIGNIFICANT), 2).otherwise(0)
    return F.least(points, F.lit(10))


def importance(path: Column, dependents: Column, dependencies: Column, packages: Column) -> Column:
    """With what the graph adds: up to 3 for dependents, 2 for dependencies, 1 for packages."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    more = F.least(zero(dependents), F.lit(3)) + F.least(zero(dependencies), F.lit(2)) + F.least(zero(packages), F.lit(1))
    return F.greatest(F.lit(0), F.least(F.lit(10), base_importance(path) + more)).cast("int")


def query_tokens(query: str) -> list[str]:
    """Quoted phrases, then words of two characters or more; lower case, wildcards stripped, first of equals kept."""
    phrases = [m.strip().lower() for m in re.findall(r'"([^"]+)"', query)]
    words = [w.lower() for w in re.sub(r'"[^"]+"', " ", query).split() if len(w) >= 2]
    return list(dict.fromkeys(t for t in (re.sub("[%_]", "", x).strip() for x in phrases + words) if t))


CONCEPTS = "functions array<string>, classes array<string>, interfaces array<string>, exports array<string>, purpose string"
IMPACT = "riskLevel string, affectedAreas array<string>, breakingChanges array<string>, summary string"


def match_rank(token: Column, concepts: Column, impact: Column, summary: Column, path: Column) -> Column:
    """100 for a symbol, 50 for the purpose or an affected area, 20 for the summary, 10 for the path, 0 for no match."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), token), F.lit(False))
    some = lambda arr: F.coalesce(F.exists(arr, lambda x: F.contains(F.lower(x), token)), F.lit(False))
    symbol = some(concepts["functions"]) | some(concepts["classes"]) | some(concepts["interfaces"]) | some(concepts["exports"])
    return F.when(symbol, 100).when(has(concepts["purpose"]) | some(impact["affectedAreas"]), 50).when(has(summary), 20).when(has(path), 10).otherwise(0)
