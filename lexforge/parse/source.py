"""Source files to (symbols, references, imports).

Python is parsed by its own grammar; the brace languages by patterns over text without comments and
literals, with spans from matched braces.  Known gaps of the latter: definitions that macros make,
calls inside macro arguments (Rust's are blanked as the contract has it), default arguments that hold
braces, and operators as function names.

Rows come in one tagged schema, so one pass over a file feeds all three tables.  A file that can't be
parsed gives no rows.  Budgets: 2 MiB of text, 100 000 named nodes, names of 200 characters.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import EXCERPT_CHARS, LANGUAGES
from lexforge.parse.blank import match_braces, without_literals

MAX_NODES, MAX_NAME, MAX_BYTES, MAX_DEPTH = 100_000, 200, 2 << 20, 128

ROWS = (
    "table string, path string, name string, kind string, line int, end_line int, column int, container string, "
    "caller string, expression string, excerpt string, statement string, candidate_files array<string>, family string, qualifier string"
)


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)


#: Keywords that look like calls.
_NOT_CALLS = frozenset(
    "if for while switch return catch sizeof match loop fn func function new await typeof throw else do try elif with in is not and or "
    "defined assert super yield delete case import export class struct enum interface def lambda".split()
)

#: Words of each family that are no identifiers (keywords, primitive types, literals).
_RESERVED = {
    "rust": frozenset(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static "
        "struct super trait true type unsafe use where while bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64".split()
    ),
    "ecmascript": frozenset(
        "break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in "
        "instanceof interface let new null private protected public return static super switch this throw true try typeof undefined var void while with "
        "yield".split()
    ),
    "go": frozenset(
        "break case chan const continue default defer else fallthrough false for func go goto if import interface iota map nil package range return select "
        "struct switch true type var".split()
    ),
    "java": frozenset(
        "abstract assert boolean break byte case catch char class continue default do double else enum extends false final finally float for if implements "
        "import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this "
        "throw throws transient true try void volatile while".split()
    ),
    "c": frozenset(
        "alignas alignof auto bool break case catch char class concept const constexpr const_cast continue co_await co_return co_yield decltype default delete "
        "do double dynamic_cast else enum explicit export extern false final float for friend goto if inline int long mutable namespace new "
        "noexcept nullptr NULL operator override private protected public register reinterpret_cast requires restrict return short signed sizeof size_t static "
        "static_assert static_cast struct switch template this throw true try typedef typename union unsigned using virtual void volatile while "
        "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split()
    ),
}

#: Words that are reserved in some places only: types, and modifiers before another word.
_SCRIPT_TYPES = frozenset("any bigint boolean never number object string symbol unknown".split())
_SCRIPT_MODIFIERS = frozenset("abstract as async await declare from get infer is keyof module namespace of override readonly satisfies set type".split())

_ID = r"[A-Za-z_$][\w$]*"
#: kind -> pattern of a definition; the group "name" is its name.
_DEFINITIONS = {
    "rust": [
        ("function", rf"\bfn\s+(?P<name>{_ID})"),
        ("struct", rf"\bstruct\s+(?P<name>{_ID})"),
        ("enum", rf"\benum\s+(?P<name>{_ID})"),
        ("trait", rf"\btrait\s+(?P<name>{_ID})"),
        ("type", rf"\btype\s+(?P<name>{_ID})"),
        ("module", rf"\bmod\s+(?P<name>{_ID})\s*\{{"),
        ("const", rf"\bconst\s+(?!fn\b)(?P<name>{_ID})\s*:"),
        ("static", rf"\bstatic\s+(?:mut\s+)?(?P<name>{_ID})\s*:"),
        ("impl", rf"(?m)^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{{;]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?:{_ID}::)*(?P<name>{_ID})[^{{;]*(?=\{{)"),
    ],
    "ecmascript": [
        ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})"),
        ("class", rf"\bclass\s+(?P<name>{_ID})"),
        ("interface", rf"\binterface\s+(?P<name>{_ID})"),
        ("type", rf"\btype\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*="),
        ("enum", rf"\benum\s+(?P<name>{_ID})"),
        ("variable", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|class\b|(?:<[^>(]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]+)?=>|{_ID}\s*=>)"),
        ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?#?(?P<name>{_ID})\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}=]+)?(?=\{{)"),
    ],
    "go": [
        ("method", rf"(?m)^func\s*\(\s*(?:{_ID}\s+)?\*?(?P<container>{_ID})[^)]*\)\s*(?P<name>{_ID})"),
        ("function", rf"(?m)^func\s+(?P<name>{_ID})"),
        ("type", rf"(?m)^type\s+(?P<name>{_ID})"),
        ("type", rf"(?m)^\t(?P<name>{_ID})\s+(?:struct|interface)\s*\{{"),
    ],
    "java": [
        ("class", rf"\b(?:class|record)\s+(?P<name>{_ID})"),
        ("interface", rf"@?\binterface\s+(?P<name>{_ID})"),
        ("enum", rf"\benum\s+(?P<name>{_ID})"),
        ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>{{;]+>\s*)?(?:[\w$.<>\[\],? ]+?\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w$., ]+)?(?=[{{;])"),
    ],
    "c": [
        ("macro", rf"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<name>{_ID})\("),
        ("struct", rf"\b(?:struct|class|union)\s+(?:\w+\s+)?(?P<name>{_ID})\s*(?:final\s*)?(?::[^;{{(]*)?(?=\{{)"),
        ("enum", rf"\benum\s+(?:class\s+|struct\s+)?(?P<name>{_ID})\s*(?::[^;{{]*)?(?=\{{)"),
        ("namespace", rf"\bnamespace\s+(?P<name>{_ID})\s*(?=\{{)"),
        ("concept", rf"\bconcept\s+(?P<name>{_ID})\s*="),
        ("alias", rf"\busing\s+(?P<name>{_ID})\s*="),
        ("typedef", rf"\btypedef\b[^;{{}}]*?(?:\{{[^{{}}]*\}})?[^;{{}}]*?\b(?P<name>{_ID})\s*;"),
        ("function", rf"(?m)(?:^|(?<=[{{}};:]))(?![ \t]*(?:return|else|if|for|while|switch|case|do|using|typedef|#)\b)[ \t]*(?:[\w:<>,*&~\[\] \t]+?[\s*&]+)?(?:(?P<container>{_ID})(?:<[^>]*>)?::)?(?P<name>~?{_ID})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const\b\s*|noexcept\b\s*|override\b\s*|final\b\s*)*(?::[^;{{}}]*)?(?=\{{)"),
    ],
}
_IMPORTS = {
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+[^;]+|mod\s+(?P<mod>\w+)\s*);",
    "ecmascript": r"""(?m)^[ \t]*(?:import|export)\b[^;\n]*?['"](?P<from>[^'"\n]+)['"]|require\(\s*['"](?P<req>[^'"\n]+)['"]\s*\)""",
    "go": r"""(?m)^import\s+(?:(?P<alias>[\w.]+)\s+)?"(?P<pkg>[^"]+)"|^\t(?:(?P<alias2>[\w.]+)\s+)?"(?P<pkg2>[^"\n]+)"$""",
    "java": r"(?m)^[ \t]*import\s+(?:static\s+)?(?P<dotted>[\w.]+)(?:\.\*)?;",
    "c": r"""(?m)^[ \t]*#[ \t]*include[ \t]*(?:"(?P<quoted>[^"\n]+)"|<[^>\n]+>)""",
}
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<full>(?:{_ID}(?:\.|::|->|\?\.))*(?P<name>~?{_ID}))(?:::<[^>(]*>|<[\w$, .\[\]?]*>)?(?P<bang>!)?\s*\(")
_NEW_ONLY = re.compile(rf"\bnew\s+(?:{_ID}\.)*(?P<name>{_ID})\b(?!\s*[(<.])")
_WORD = re.compile(rf"(?<![\w$]){_ID}")
_JS_ENDS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")


def _clean(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return ""
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def import_candidates(family: str, path: str, target: str, kind: str = "") -> list[str]:
    """Files of the workspace that an import may mean."""
    parent = path.rpartition("/")[0]
    here = lambda p: _clean(f"{parent}/{p}" if parent else p)
    if family == "python":
        return [f"{target.replace('.', '/')}.py", f"{target.replace('.', '/')}/__init__.py"] if target and not target.startswith(".") else []
    if family == "rust":
        if kind != "mod":
            return []
        stem = path.rpartition("/")[2].removesuffix(".rs")
        base = parent if stem in ("lib", "main", "mod") else f"{parent}/{stem}" if parent else stem
        return [_clean(f"{base}/{target}.rs"), _clean(f"{base}/{target}/mod.rs")]
    if family == "ecmascript":
        if not target.startswith("."):
            return []
        base = here(target)
        stem, _, end = base.rpartition(".")
        swaps = {"js": ("js", "ts", "tsx"), "jsx": ("jsx", "tsx"), "mjs": ("mjs", "mts"), "cjs": ("cjs", "cts")}
        if end in swaps and stem:
            return [f"{stem}.{e}" for e in swaps[end]]
        if "." in base.rpartition("/")[2]:
            return [base]
        return [f"{base}.{e}" for e in _JS_ENDS] + [f"{base}/index.{e}" for e in _JS_ENDS]
    if family == "java":
        file = target.replace(".", "/") + ".java"
        return [file, "src/main/java/" + file]
    if family == "c":
        return [c for c in dict.fromkeys((_clean(target), here(target))) if c] if target else []
    return []


class _Lines:
    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1

    def line(self, number: int) -> str:
        start = self.starts[number - 1]
        end = self.starts[number] if number < len(self.starts) else len(self.text)
        return self.text[start:end].rstrip("\r\n")


def parse_text(path: str, text: str) -> Parsed:
    """The rows of one file; unknown languages have none."""
    entry = LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path else None
    if entry is None or len(text.encode()) > MAX_BYTES or "\0" in text:
        return Parsed()
    try:
        return _python(path, text) if entry[1] == "python" else _braces(path, text, entry[1])
    except (SyntaxError, ValueError, RecursionError):
        return Parsed()


def _symbol(name, kind, path, line, end, column, container, excerpt, family) -> dict:
    return {"name": name, "kind": kind, "path": path, "line": line, "end_line": end, "column": column, "container": container, "excerpt": excerpt[:EXCERPT_CHARS], "family": family}


def _ref(name, kind, path, line, column, caller, expression, excerpt, family, qualifier=None) -> dict:
    shown = "" if expression == name else expression[:EXCERPT_CHARS]
    return {"name": name, "kind": kind, "path": path, "line": line, "column": column, "caller": caller, "expression": shown, "excerpt": excerpt[:EXCERPT_CHARS], "family": family, "qualifier": qualifier}


def _python(path: str, text: str) -> Parsed:
    out, shown, budget = Parsed(), _Lines(text), [MAX_NODES]
    skip: set[tuple[int, int]] = set()

    def visit(node: ast.AST, owner: str | None, container: str | None, depth: int) -> None:
        if depth > MAX_DEPTH or budget[0] <= 0:
            return
        budget[0] -= 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            if len(node.name) <= MAX_NAME:
                out.symbols.append(_symbol(node.name, kind, path, node.lineno, node.end_lineno, node.col_offset + 1, container, shown.line(node.lineno).strip(), "python"))
            for child in getattr(node, "decorator_list", []):
                visit(child, owner, container, depth + 1)
            for child in ast.iter_child_nodes(node):
                if child in getattr(node, "decorator_list", []):
                    continue
                visit(child, node.name, node.name, depth + 1)
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            statement = ast.get_source_segment(text, node) or ""
            if isinstance(node, ast.Import):
                for alias in node.names:
                    out.imports.append({"path": path, "line": node.lineno, "statement": statement[:EXCERPT_CHARS], "candidate_files": import_candidates("python", path, alias.name)})
            else:
                target = node.module if not node.level else "." + (node.module or "")
                out.imports.append({"path": path, "line": node.lineno, "statement": statement[:EXCERPT_CHARS], "candidate_files": import_candidates("python", path, target or "")})
            return
        if isinstance(node, ast.Lambda):
            for child in [*node.args.defaults, *filter(None, node.args.kw_defaults), node.body]:
                visit(child, owner, container, depth + 1)
            return
        if isinstance(node, ast.arguments):  # what parameters hold are no uses, but calls in defaults count
            before = len(out.refs)
            for child in [*node.defaults, *filter(None, node.kw_defaults)]:
                visit(child, owner, container, depth + 1)
            out.refs[before:] = [r for r in out.refs[before:] if r["kind"] == "call"]
            return
        if isinstance(node, ast.Call):
            target = node.func
            name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
            if name and len(name) <= MAX_NAME:
                full = ast.get_source_segment(text, target) or name
                line, column = (target.end_lineno, target.end_col_offset - len(name) + 1) if isinstance(target, ast.Attribute) else (target.lineno, target.col_offset + 1)
                out.refs.append(_ref(name, "call", path, line, column, owner, full, shown.line(line).strip(), "python"))
                skip.add((line, column))
        elif isinstance(node, ast.Name) and (node.lineno, node.col_offset + 1) not in skip:
            out.refs.append(_ref(node.id, "possible_reference", path, node.lineno, node.col_offset + 1, owner, node.id, shown.line(node.lineno).strip(), "python"))
        elif isinstance(node, ast.Attribute):
            place = (node.end_lineno, node.end_col_offset - len(node.attr) + 1)
            if place not in skip:
                out.refs.append(_ref(node.attr, "possible_reference", path, *place, owner, ast.get_source_segment(text, node) or node.attr, shown.line(place[0]).strip(), "python"))
        for child in ast.iter_child_nodes(node):
            visit(child, owner, container, depth + 1)

    visit(ast.parse(text), None, None, 0)
    out.refs.sort(key=lambda r: (r["line"], r["column"]))
    return out


def _closing(bare: str, at: int) -> int:
    """The offset after the parenthesis that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(bare, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(bare)


_TYPE_PARAMETERS = re.compile(r"\s*<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>")
_ASSIGNED = re.compile(r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*)?")
_IMPL = re.compile(r"(?:unsafe\s+)?impl\b")


def _is_script_word(bare: str, word: re.Match) -> bool:
    """Whether a word of a script is the name of a property, a type of the language or a modifier."""
    before = bare[max(0, word.start() - 20) : word.start()]
    if before.endswith((".", "#")) and not before.endswith("..."):
        return True
    if word[0] in _SCRIPT_TYPES:
        return re.search(r"(?:[:<|&]|\bas|\bis)\s*$", before) is not None
    return word[0] in _SCRIPT_MODIFIERS and re.match(r"[ \t]+(?!(?:as|of|in|is|satisfies|instanceof)\b)[\w$({<\[\"'`]", bare[word.end() : word.end() + 20]) is not None


def _declared(bare: str, family: str, kind: str, start: int, name: int, size: int) -> list[tuple[int, int]]:
    """Ranges of the parameters (types of them too) that a definition declares."""
    spans, at = [], name + size
    if kind == "impl":
        head = _IMPL.match(bare, start)
        generic = head and _TYPE_PARAMETERS.match(bare, head.end())
        return [generic.span()] if generic else []
    if family == "go" and kind == "method":
        spans.append((start, name))  # the receiver
    if kind == "variable":
        at = _ASSIGNED.match(bare, at).end() if _ASSIGNED.match(bare, at) else at
    if generic := _TYPE_PARAMETERS.match(bare, at):
        spans.append(generic.span())
        at = generic.end()
    if kind in ("function", "method", "variable", "macro"):
        opened = re.compile(r"\s*\(").match(bare, at)
        while opened:
            end = _closing(bare, opened.end() - 1)
            spans.append((opened.start(), end))
            # results of Go in parentheses are declared like parameters
            opened = re.compile(r"[ \t]*\(").match(bare, end) if family == "go" else None
    return spans


def _braces(path: str, text: str, family: str) -> Parsed:
    bare = without_literals(text, family)
    if family == "rust":  # arguments of macros are invisible
        bare = re.sub(r"\b(\w+)!\s*(\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])", lambda m: m[1] + "!" + re.sub(r"[^\n]", " ", m[2]), bare)
    shown, pairs, out = _Lines(text), match_braces(bare), Parsed()
    opens = sorted(pairs)
    found: list[tuple[int, int, str, str, str | None, int]] = []  # start, end, kind, name, container, name offset
    names: set[int] = set()
    for kind, pattern in _DEFINITIONS[family]:
        for m in re.finditer(pattern, bare):
            name = m["name"]
            if name in _NOT_CALLS or name in _RESERVED[family] or len(name) > MAX_NAME or m.start("name") in names and kind != "impl":
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            k = bisect_right(opens, m.end() - 1) if not bare[m.end() - 1 : m.end()] == "{" else bisect_right(opens, m.end() - 2)
            end = m.end()
            if k < len(opens):
                between = bare[m.end() : opens[k]]
                if kind not in ("typedef", "alias") and ";" not in between and "}" not in between:
                    end = pairs[opens[k]]
            if kind == "macro":
                end = m.end()
                while shown.line(shown.at(end)[0]).endswith("\\") and shown.at(end)[0] < len(shown.starts):
                    end = shown.starts[shown.at(end)[0]]
            if kind == "method" and family == "java" and end == m.end() and re.match(r"\s*(return|new|throw|else|do|assert|yield)\b", m[0]):
                continue
            if kind == "method" and family == "java" and end == m.end() and not re.search(rf"[\w>\]]\s+{re.escape(name)}\s*\(", m[0]):
                continue  # a call as a statement
            groups = m.groupdict()
            names.add(m.start("name"))
            found.append((start, end, kind, name, groups.get("container"), m.start("name")))
            if len(found) > MAX_NODES:
                break
    found.sort(key=lambda f: (f[0], -f[1]))
    seen: set[tuple] = set()
    for start, end, kind, name, container, at in found:
        if kind == "impl":
            continue
        line, column = shown.at(at)
        first, last = shown.at(start)[0], shown.at(max(start, end - 1 if bare[end : end + 1] != "}" else end))[0]
        outer = [f for f in found if f[0] < start and f[1] >= end and f[1] > f[0] and f[2] not in ("function", "method", "variable", "macro", "const", "static")]
        owner = container or (outer[-1][3] if outer else None)
        if (name, first, last) in seen:
            continue
        seen.add((name, first, last))
        out.symbols.append(_symbol(name, kind, path, first, last, column, owner, shown.line(first).strip(), family))
    bodies = [f for f in found if f[2] in ("function", "method", "variable", "macro", "class", "struct") and f[1] > f[0]]

    def owner_of(offset: int) -> str | None:
        around = [f for f in bodies if f[0] <= offset <= f[1] and offset != f[5]]
        return max(around, key=lambda f: f[0])[3] if around else None

    taken: set[int] = set()
    for m in _CALL.finditer(bare):
        name = m["name"]
        at = m.start("name")
        before = bare[max(0, at - 12) : at]
        if name[0] == "~" and m["full"] == name:
            continue  # a destructor's declaration
        if name in _NOT_CALLS or name in _RESERVED[family] or at in names or m["bang"] or re.search(r"\b(fn|func|function|def)\s+$", before):
            continue
        line, column = shown.at(at)
        taken.add(at)
        prefix = m["full"][: -len(name)].rstrip(".:>?-")
        out.refs.append(_ref(name, "call", path, line, column, owner_of(at), m["full"], shown.line(line).strip(), family, prefix or None))
    for m in _NEW_ONLY.finditer(bare):
        line, column = shown.at(m.start("name"))
        taken.add(m.start("name"))
        out.refs.append(_ref(m["name"], "call", path, line, column, owner_of(m.start("name")), m["name"], shown.line(line).strip(), family))
    spans = []
    for m in re.finditer(_IMPORTS[family], text if family in ("ecmascript", "go", "c") else bare):
        spans.append(m.span())
        g = {k: v for k, v in m.groupdict().items() if v}
        target = next((g[k] for k in ("mod", "from", "req", "pkg", "pkg2", "dotted", "quoted") if k in g), "")
        statement = text[m.start() : m.end()].strip()
        out.imports.append({
            "path": path, "line": shown.at(m.start() + len(m[0]) - len(m[0].lstrip()))[0], "statement": statement[:EXCERPT_CHARS],
            "candidate_files": import_candidates(family, path, target, "mod" if "mod" in g else ""),
        })
    for start, _, kind, name, _, at in found:
        spans += _declared(bare, family, kind, start, at, len(name))
    if family in ("go", "java"):
        spans += [m.span() for m in re.finditer(r"(?m)^[ \t]*package\s+[\w.]+", bare)][:1]
    spans.sort()
    reach = list(accumulate((e for _, e in spans), max))
    begins = [b for b, _ in spans]
    for m in _WORD.finditer(bare):
        at = m.start()
        if at in taken or at in names or m[0] in _RESERVED[family] or len(m[0]) > MAX_NAME:
            continue
        k = bisect_right(begins, at)
        if k and at < reach[k - 1]:
            continue  # in an import or among declared parameters
        if family == "ecmascript" and _is_script_word(bare, m) or family == "c" and re.search(r"#[ \t]*$", bare[max(0, at - 20) : at]):
            continue
        if len(out.refs) > MAX_NODES:
            break
        line, column = shown.at(at)
        out.refs.append(_ref(m[0], "possible_reference", path, line, column, owner_of(at), m[0], shown.line(line).strip(), family))
    out.refs.sort(key=lambda r: (r["line"], r["column"]))
    return out


def _rows(batches: Iterator[pd.DataFrame], references: bool) -> Iterator[pd.DataFrame]:
    columns = [c.strip().split(" ")[0] for c in ROWS.split(", ")]
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            got = parse_text(path, text or "")
            rows += [{"table": "symbol", **s} for s in got.symbols]
            rows += [{"table": "ref", **r} for r in got.refs if references or r["kind"] == "call"]
            rows += [{"table": "import", **i} for i in got.imports]
        frame = pd.DataFrame(rows, columns=columns).astype(object)
        yield frame.where(frame.notna(), None)


def parse(files: DataFrame, references: bool = False) -> DataFrame:
    """All rows of all files (:data:`ROWS`); without ``references``, only calls of the references.

    Filters on ``files`` belong before this: nothing is pushed through a Python function.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(batches, references)

    return files.select("path", "text").mapInPandas(run, ROWS)


def symbols(rows: DataFrame) -> DataFrame:
    found = rows.where(F.col("table") == "symbol")
    ident = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"))
    return found.select(ident.alias("id"), "name", "kind", "path", "line", "end_line", "container", "excerpt", "family")


def refs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("table") == "ref").select("name", "kind", "path", "line", "column", "caller", "expression", "excerpt", "family", "qualifier")


def imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with those candidates that exist, and what that says.

    ``rows`` are asked for once, as they may be parsed anew each time.  Paths and candidates meet by a merge join: the size that
    Spark expects of parsed rows and derived paths is far below the real one, and a broadcast would bring the whole tree to the driver.
    """
    place = ["path", "line", "statement"]
    raw = rows.where(F.col("table") == "import").groupBy(*place)
    raw = raw.agg(F.count(F.lit(1)).alias("__copies"), F.array_distinct(F.flatten(F.collect_list("candidate_files"))).alias("__wanted"))
    # an import without candidates gets a path that no file has, else all of them would meet under null
    file = F.coalesce(F.col("file"), F.concat(F.lit("\0"), "path"))
    wanted = raw.select(*place, "__copies", F.explode_outer("__wanted").alias("file")).withColumn("file", file)
    held = files.select(F.col("path").alias("file"), F.col("path").alias("__held"))
    kept = wanted.join(held.hint("merge"), "file", "left").groupBy(*place, "__copies").agg(F.array_sort(F.collect_set("__held")).alias("candidate_files"))
    resolution = F.when(F.size("candidate_files") > 0, "possible_local_module").otherwise("unresolved")
    return kept.select(*place, "candidate_files", resolution.alias("resolution"), F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).drop("col")


def go_packages(calls: DataFrame, go_imports: DataFrame, module: str | None) -> DataFrame:
    """Calls with the folder their qualifier means: the import whose alias (or last part) it is, inside the module."""
    target = F.regexp_extract("statement", r'"([^"]+)"', 1)
    alias = F.coalesce(F.nullif(F.regexp_extract("statement", r'^(?:import\s+)?([\w.]+)\s+"', 1), F.lit("")), F.substring_index(target, "/", -1))
    prefix = (module or "") + "/"
    folder = F.when(target.startswith(prefix), F.substring(target, F.lit(len(prefix) + 1), F.char_length(target))).otherwise(F.lit("\0outside"))
    named = go_imports.select("path", alias.alias("qualifier"), folder.alias("package")).dropDuplicates(["path", "qualifier"])
    return calls.join(named, ["path", "qualifier"], "left")


def budgeted(files: DataFrame, most_files: int = 20_000, most_bytes: int = 128 << 20) -> DataFrame:
    """The leading files, by path, that an index may hold.

    The order is global by nature, but only paths and sizes are ordered, each partition gives its first
    ``most_files`` at most, and the running total is of these alone.
    """
    from pyspark.sql import Window

    order = F.split("path", "/")
    leading = files.select("path", F.octet_length("text").alias("bytes")).orderBy(order).limit(most_files)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = leading.withColumn("total", F.sum("bytes").over(w)).where(F.col("total") <= most_bytes).select("path")
    return files.join(kept, "path", "left_semi")
