"""Text of one source file to imports, symbols and calls. Plain functions; loamgraph.operators.parse runs them over DataFrames.

Every parser returns a Parsed. Imports keep the specifier as written; resolving it to a file is a join (operators.parse). Masking
blanks out comments and the insides of strings but keeps every offset, so patterns meet code only and lines stay right.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

EXTRACTED, INFERRED = 1.0, 0.8


@dataclass
class Parsed:
    #: (specifier, edge_type, names or None, line or None, is_package)
    edges: list[tuple] = field(default_factory=list)
    #: (name, kind, start_line, end_line, is_export)
    symbols: list[tuple] = field(default_factory=list)
    #: (caller, caller_line, callee, line)
    calls: list[tuple] = field(default_factory=list)
    #: (name, kind, signature)
    exports: list[tuple] = field(default_factory=list)
    confidence: float = EXTRACTED


#: A slash where a value must begin: at the start of a statement, after an operator, an opening bracket, a comma or certain keywords.
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\-*%<>~^\n])|(?<=[=(,:;!&|?{}\[+\-*%<>~^] )|(?<=\breturn )|(?<=\btypeof )|(?<=\bcase ))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"


def mask(text: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", triple: bool = False, regexes: bool = False) -> str:
    """text with comments and string contents blanked, quotes and line breaks kept. ${} in backquoted strings stays blank. regexes: also the
    insides of regular expression literals, known by what stands before their slash."""
    parts = [re.escape(line) + r"[^\n]*"]
    if block:
        parts.append(re.escape(block[0]) + r"[\s\S]*?(?:" + re.escape(block[1]) + r"|\Z)")
    if triple:
        parts += [r'"""[\s\S]*?(?:"""|\Z)', r"'''[\s\S]*?(?:'''|\Z)"]
    for q in quotes:
        parts.append(rf"{q}(?:\\[\s\S]|[^{q}\\])*(?:{q}|\Z)" if q == "`" else rf"{q}(?:\\[\s\S]|[^{q}\\\n])*{q}?")
    if regexes:
        parts.append(_REGEX)
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def put(m: re.Match) -> str:
        s = m[0]
        if s[0] in quotes and not (triple and s[:3] in ('"""', "'''")):
            return s[0] + blank(s[1:-1]) + s[-1] if len(s) > 1 else s
        return blank(s)

    return re.sub("|".join(parts), put, text)


class Text:
    """A masked text with line numbers and bracket depths."""

    def __init__(self, text: str, masked: str):
        self.text, self.masked = text, masked
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.marks, self.depths = [0], [0]
        for m in re.finditer(r"[(\[{}\])]", masked):
            self.marks.append(m.start() + (m[0] in "([{"))
            self.depths.append(max(0, self.depths[-1] + (1 if m[0] in "([{" else -1)))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def depth(self, at: int) -> int:
        return self.depths[bisect_right(self.marks, at) - 1]

    def closing(self, at: int) -> int:
        """Where the bracket that opens at ``at`` closes."""
        want = self.depth(at)
        k = bisect_left(self.marks, at + 1) + 1
        while k < len(self.depths) and self.depths[k] > want:
            k += 1
        return self.marks[k] if k < len(self.marks) else len(self.masked)

    def quoted(self, at: int) -> str:
        """The string whose opening quote stands at ``at``."""
        q = self.masked[at]
        end = self.masked.find(q, at + 1)
        return self.text[at + 1 : end if end >= 0 else len(self.text)]


KEYWORDS = frozenset("if for while switch catch function return typeof await new in of do else super import require case delete void yield with throw instanceof".split())
_TS_IMPORT = re.compile(r"\bimport\b(?!\s*\()\s*(type\s+)?(?P<clause>[^'\"`;()]*?)(?:\bfrom\b)?\s*(?P<q>['\"])")
_TS_CALL_IMPORT = re.compile(r"(?<![.\w$])(?:require|import)\s*\(\s*(?P<q>['\"`])")
_TS_REEXPORT = re.compile(r"\bexport\b\s*(?:type\s+)?(?P<clause>\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(?P<q>['\"])")
_TS_SYMBOL = re.compile(r"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?<![.\w$])(?P<kind>function|class|interface|type|enum|const\s+enum|const)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)")
_ARROW = re.compile(r"\s*(?::(?:[^=]|=>)*?)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]*)?=>|[A-Za-z_$][\w$]*\s*=>)")
_CALL = re.compile(r"(?<![.\w$])([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")


def _clause_names(clause: str) -> list[str]:
    names = []
    braces = re.search(r"\{([^}]*)\}", clause)
    rest = re.sub(r"\{[^}]*\}", "", clause)
    if re.search(r"\*\s*as\s+[\w$]+", rest):
        names.append("*")
    if re.match(r"\s*[A-Za-z_$][\w$]*", rest):
        names.append("default")
    if braces:
        names += [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", p.strip()))[0] for p in braces[1].split(",") if p.strip()]
    return names


def _local_names(clause: str) -> list[str]:
    """Names that the clause binds here, for what a class extends."""
    braces = re.search(r"\{([^}]*)\}", clause)
    out = re.findall(r"\*\s*as\s+([\w$]+)", clause) + re.findall(r"^\s*([A-Za-z_$][\w$]*)", re.sub(r"\{[^}]*\}", "", clause))
    return out + ([re.split(r"\s+as\s+", p.strip())[-1].removeprefix("type ") for p in braces[1].split(",") if p.strip()] if braces else [])


def parse_ts(text: str) -> Parsed:
    """TypeScript and JavaScript."""
    out, t = Parsed(), Text(text, mask(text, regexes=True))
    bound: dict[str, str] = {}
    add = lambda spec, kind, names=None, line=None: "${" in spec or out.edges.append((spec, kind, names, line, not spec.startswith((".", "/"))))
    found = [(m.start(), "imports", m) for m in _TS_IMPORT.finditer(t.masked) if t.depth(m.start()) == 0]
    found += [(m.start(), "call", m) for m in _TS_CALL_IMPORT.finditer(t.masked)]
    found += [(m.start(), "re_exports", m) for m in _TS_REEXPORT.finditer(t.masked) if t.depth(m.start()) == 0]
    for at, kind, m in sorted(found, key=lambda x: x[0]):
        spec = t.quoted(m.start("q"))
        if kind == "imports":
            add(spec, kind, _clause_names(m["clause"]), t.line(at))
            bound |= dict.fromkeys(_local_names(m["clause"]), spec)
        else:
            add(spec, "imports" if kind == "call" else kind)
    scopes = []
    for m in _TS_SYMBOL.finditer(t.masked):
        if t.depth(m.start()) or (m["kind"] == "type" and not re.match(r"\s*(?:<[^=]*>)?\s*=", t.masked[m.end() :])):
            continue
        kind, end = m["kind"].split()[-1], len(t.masked)
        arrow = kind == "const" and _ARROW.match(t.masked, m.end())
        brace = t.masked.find("{", m.end())
        stop = re.compile(r";|\n(?=\s*(?:export|import|const|let|var|function|class|interface|type|enum|abstract|async|declare)\b)").search
        if kind in ("const", "type"):
            s = next((x.start() for x in iter_from(stop, t.masked, m.end()) if t.depth(x.start()) == 0), None)
            end = s if s is not None else len(t.masked.rstrip())
        elif brace >= 0:
            while t.depth(brace) and brace >= 0:
                brace = t.masked.find("{", brace + 1)
            end = t.closing(brace) if brace >= 0 else end
        kind = "function" if arrow else kind
        first, last = t.line(m.start()), t.line(max(m.start(), min(end, len(t.text) - 1)))
        out.symbols.append((m["name"], kind, first, last, bool(m["export"])))
        if m["export"]:
            head = t.text[m.start() : end].split("\n")[0].split("{")[0].strip()
            out.exports.append(("default" if m["default"] else m["name"], kind, head))
        if kind in ("function", "class"):
            scopes.append((m["name"], first, m.end(), end))
        if kind == "class":
            base = re.match(r"\s*(?:<[^{]*?>)?\s*extends\s+([A-Za-z_$][\w$]*)", t.masked[m.end() :])
            if base and base[1] in bound:
                add(bound[base[1]], "inherits")
    for name, first, begin, end in scopes:
        for c in _CALL.finditer(t.masked, begin, end):
            before = t.masked[:c.start()].rstrip()[-12:]
            if c[1] not in KEYWORDS and not re.search(r"(?:\bnew|\bfunction\s*\*?)$", before) and not re.match(r"\s*(?::[^{;]*)?\{", t.masked[t.closing(c.end() - 1) + 1 : t.closing(c.end() - 1) + 81]):
                out.calls.append((name, first, c[1], t.line(c.start())))
    return out


def iter_from(search, text: str, at: int):
    while (m := search(text, at)) is not None:
        yield m
        at = max(m.end(), at + 1)


def parse_python(text: str) -> Parsed:
    """Python, by its own parser; a relative import keeps its dots."""
    out = Parsed()
    tree = ast.parse(text)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.edges += [(a.name, "imports", None, node.lineno, True) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            spec = "." * node.level + (node.module or "")
            out.edges.append((spec, "imports", [a.name for a in node.names], node.lineno, not node.level))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.symbols.append((node.name, kind, first, node.end_lineno, not node.name.startswith("_")))
    return out


def parse_go(text: str) -> Parsed:
    out, t = Parsed(confidence=INFERRED), Text(text, mask(text))
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?(?=[\"`]))", t.masked, re.M):
        end = m.end() if m[1] is not None else t.masked.find("\n", m.end()) % (len(t.masked) + 1)
        for q in re.finditer(r"[\"`][^\"`\n]*[\"`]", t.masked[m.start() : end]):
            out.edges.append((t.quoted(m.start() + q.start()), "imports", None, t.line(m.start() + q.start()), True))

    def add(name: str, kind: str, begin: int, end: int) -> None:
        out.symbols.append((name, kind, t.line(begin), t.line(end), "A" <= name[0] <= "Z"))

    for m in re.finditer(r"^(?:func\s*(?:\([^)]*\)\s*)?(?P<f>\w+)|type\s+(?P<t>\w+)(?:\[[^\]]*\])?\s+(?P<k>struct\b|interface\b|=|\S)|const\s+(?P<c>\w+)|(?P<g>(?:const|type)\s*\())", t.masked, re.M):
        brace = t.masked.find("{", m.end() - 1)
        line_end = t.masked.find("\n", m.end())
        line_end = len(t.masked) if line_end < 0 else line_end
        if m["f"]:
            while 0 <= brace and t.depth(brace):
                brace = t.masked.find("{", brace + 1)
            add(m["f"], "function", m.start(), t.closing(brace) - 0 if brace >= 0 else line_end)
        elif m["t"]:
            own = m["k"] if m["k"] in ("struct", "interface") else "type"
            add(m["t"], own, m.start(), t.closing(brace) if own != "type" and brace >= 0 else line_end - 1)
        elif m["c"]:
            add(m["c"], "const", m.start(), line_end - 1)
        else:
            end = t.closing(m.end() - 1)
            for g in re.finditer(r"^[ \t]*([A-Za-z_]\w*)\b\s*(struct\b|interface\b)?", t.masked[m.end() : end], re.M):
                if t.depth(m.end() + g.start(1)) == 1:
                    add(g[1], "const" if m["g"].startswith("const") else g[2] or "type", m.end() + g.start(1), m.end() + g.start(1))
    return out


def parse_ruby(text: str) -> Parsed:
    out, t = Parsed(confidence=INFERRED), Text(text, mask(text, "#", ("\n=begin", "\n=end"), "\"'"))
    for m in re.finditer(r"(?<![\w.])(require_relative|require)\s*\(?\s*(?P<q>['\"])", t.masked):
        spec = t.quoted(m.start("q"))
        if "#{" not in spec:
            local = m[1] == "require_relative" or spec.startswith(("./", "../"))
            out.edges.append((spec if not local or spec.startswith(".") else "./" + spec, "imports", None, t.line(m.start()), not local))
    # top level is what starts in the first column; its end stands there too
    for m in re.finditer(r"^(?:(?P<k>def|class|module)\s+(?P<n>(?:self\.)?[\w:]+[?!=]?)|(?P<c>[A-Z]\w*)\s*=(?!=))", t.masked, re.M):
        if m["c"]:
            out.symbols.append((m["c"], "const", t.line(m.start()), t.line(m.start()), True))
        else:
            line_end = t.masked.find("\n", m.end())
            one = re.search(r";\s*end\s*$|\)\s*=\s", t.masked[m.end() : line_end if line_end >= 0 else None])
            end = m if one else re.compile(r"^end\b", re.M).search(t.masked, m.end())
            out.symbols.append((m["n"].removeprefix("self."), {"def": "function"}.get(m["k"], m["k"]), t.line(m.start()), t.line(end.start()) if end else len(t.starts), True))
    return out


def use_paths(tree: str) -> list[str]:
    """The paths of a use tree: groups multiplied out, renames dropped, * and self standing for the path before them."""
    tree = tree.strip()
    head, brace, rest = tree.partition("{")
    if not brace:
        path = re.split(r"\s+as\s+", tree)[0].replace(" ", "").removesuffix("::*").removesuffix("::self")
        return [path] if path and path != "*" else []
    depth, parts, last = 0, [], 0
    for i, c in enumerate(rest):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                rest = rest[:i]
                break
        elif c == "," and not depth:
            parts.append(rest[last:i])
            last = i + 1
    parts.append(rest[last:])
    head = head.replace(" ", "")
    return [path for part in parts if part.strip() for path in ([head.removesuffix("::")] if part.strip() in ("self", "*") else use_paths(head + part.strip()))]


def parse_rust(text: str) -> Parsed:
    out, t = Parsed(), Text(text, mask(text, quotes='"'))
    for m in re.finditer(r"\b(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<u>[\w:*{][^;]*);|extern\s+crate\s+(?P<e>\w+)|mod\s+(?P<m>\w+)\s*;)", t.masked):
        line = t.line(m.start())
        if m["m"]:
            out.edges.append((f"./{m['m']}", "imports", None, line, False))
        elif m["e"]:
            out.edges.append((m["e"], "imports", None, line, True))
        else:
            seen = set()
            for path in use_paths(re.sub(r"\s+", " ", m["u"])):
                head, *rest = path.strip(":").split("::")
                local = head in ("crate", "super", "self")
                spec = "./" + "/".join(rest) if local else head
                if spec not in seen and (rest or not local):
                    seen.add(spec)
                    out.edges.append((spec, "imports", None, line, not local))
    return out


def parse_c(text: str) -> Parsed:
    out = Parsed()
    masked = Text(text, mask(text, quotes=""))
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|\"([^\"\n]+)\")", masked.masked, re.M):
        out.edges.append((m[1] or "./" + m[2], "imports", None, masked.line(m.start()), bool(m[1])))
    return out


# Import patterns of languages that are only matched by pattern; the first group that is set is the specifier.
PATTERNS = {
    ".lua": r"require\s*\(?['\"]([^'\"]+)['\"]\)?",
    ".zig": r"@import\s*\(?['\"]([^'\"]+)['\"]\)?",
    ".php": r"(?:require|require_once|include|include_once)\s*\(?[\"']([^\"']+)[\"']\)?|use\s+([A-Za-z0-9\\]+(?:\s+as\s+[A-Za-z0-9]+)?);",
    ".cs": r"using\s+([\w.]+);",
    ".java": r"import\s+([\w.]+);",
}


def parse_pattern(text: str, pattern: str) -> Parsed:
    out = Parsed(confidence=INFERRED)
    for m in re.finditer(pattern, text):
        spec = next(g for g in m.groups() if g)
        out.edges.append((spec, "imports", None, text.count("\n", 0, m.start()) + 1, not spec.startswith((".", "/"))))
    return out


#: Parsers by extension, lower case with its dot; register adds to them.
PARSERS = dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), parse_ts) | dict.fromkeys((".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), parse_c) | {".py": parse_python, ".go": parse_go, ".rb": parse_ruby, ".rs": parse_rust}


def register(extension: str, parser: Callable[[str], Parsed]) -> None:
    """Has files with that extension parsed by a function of their text. It travels to the executors with the parsing job, so it must be importable there or defined in a way that pickles."""
    PARSERS[extension.lower()] = parser


def parse(path: str, text: str | None) -> Parsed:
    """By extension, case ignored. Unknown kinds and texts that can't be parsed give nothing."""
    ext = re.search(r"[^/](\.[^./]*)$", path or "")
    ext = ext[1].lower() if ext else ""
    try:
        if ext in PARSERS:
            return PARSERS[ext](text or "")
        if ext in PATTERNS:
            return parse_pattern(text or "", PATTERNS[ext])
    except (SyntaxError, ValueError, RecursionError):
        pass
    return Parsed()


def specifier(statement: str) -> str | None:
    """The specifier in one import statement: dynamic, require, from or bare."""
    for p in (r"import\s*\(\s*['\"]([^'\"]+)", r"require\s*\(\s*['\"]([^'\"]+)", r"from\s+['\"]([^'\"]+)", r"import\s+['\"]([^'\"]+)"):
        if m := re.search(p, statement):
            return m[1]
    return None
