"""Facts about source code: modules, classes, functions, imports, calls, bases, raises.

Each language has a reader that turns a text into (s, p, o) names; a file that can't
be read gives no facts. `facts` runs them over a table of files.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fact = tuple[str, str, str]
NAME = re.compile(r"[\w.-]+")
VENDORED = ("node_modules", "vendor", "third_party", "target", "build", "dist", "__pycache__", "venv")


class Facts:
    """Facts in the order found, once each, of representable names only."""

    def __init__(self, module: str):
        self.module = module
        self.found: dict[Fact, None] = {(module, "rdf:type", "Module"): None}

    def add(self, s: str, p: str, o: str) -> None:
        if NAME.fullmatch(s) and NAME.fullmatch(o):
            self.found[s, p, o] = None

    def define(self, name: str, kind: str) -> None:
        self.add(name, "rdf:type", kind)
        self.add(name, "defined_in", self.module)

    def rows(self) -> list[Fact]:
        return list(self.found)


def resolved(name: str, names: dict[str, str]) -> str:
    """A dotted name whose first part is replaced by what it stands for."""
    head, dot, rest = name.partition(".")
    return names.get(head, head) + dot + rest


# Python, by its own parser.


def _dotted(e: ast.expr | None) -> str:
    """a.b.c for names and attributes; empty for anything else."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute) and (left := _dotted(e.value)):
        return f"{left}.{e.attr}"
    return ""


def python_facts(source: str, module: str) -> list[Fact]:
    tree, out = ast.parse(source), Facts(module)
    names = {x.name: f"{module}.{x.name}" for x in tree.body if hasattr(x, "name") and isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))}

    def full(name: str, cls: str) -> str:
        return resolved(name, names | ({"self": cls, "cls": cls} if cls else {}))

    # Depth first in order of the source: (node, enclosing class, enclosing function).
    todo: list[tuple[ast.AST, str, str]] = [(tree, "", "")]
    while todo:
        node, cls, func = todo.pop()
        inside = (cls, func)
        if isinstance(node, ast.Import):
            for a in node.names:
                out.add(module, "imports", a.name)
                names[a.asname or a.name.split(".")[0]] = a.name
        elif isinstance(node, ast.ImportFrom):
            package = module.split(".")[: -node.level] if node.level else []
            if not node.level or package:
                target = ".".join([*package, *filter(None, [node.module])])
                if target:
                    out.add(module, "imports", target)
                    names |= {a.asname or a.name: f"{target}.{a.name}" for a in node.names if a.name != "*"}
        elif isinstance(node, ast.ClassDef):
            name = f"{cls or module}.{node.name}"
            out.define(name, "Class")
            for base in node.bases:
                if of := _dotted(base.value if isinstance(base, ast.Subscript) else base):
                    out.add(name, "rdfs:subClassOf", full(of, cls))
            inside = (name, func)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f"{cls or module}.{node.name}"
            out.define(name, "Function")
            inside = (cls, name)
        elif isinstance(node, ast.Call) and func:
            if called := _dotted(node.func):
                out.add(func, "calls", full(called, cls))
        elif isinstance(node, ast.Raise) and func:
            if what := _dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc):
                out.add(func, "raises", full(what, cls))
        todo += [(child, *inside) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out.rows()


# Languages with braces: a tokenizer and a tracker of scopes.

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
      | (?P<word>[A-Za-z_$][\w$]*!?(?=[^=]|$)|[A-Za-z_$][\w$]*)
      | (?P<number>\d[\w.]*)
      | (?P<op>::|->|=>|\.\.\.|[{}()\[\];,.<>=&*:+\-/|!?~@\#%^])""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str


def tokens(source: str, rust: bool = False) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        if rust and (m := re.compile(r"'[A-Za-z_]\w*(?!')").match(source, at)):
            at = m.end()  # a lifetime
            continue
        m = TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


@dataclass
class Scope:
    """kind: namespace, class, function or block; name: the full name of the nearest named scope."""

    kind: str
    name: str
    cls: str = ""
    func: str = ""


@dataclass
class Reader:
    """Tokens of a file with the scopes that their braces open."""

    module: str
    toks: list[Token]
    out: Facts = field(init=False)
    names: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.out = Facts(self.module)

    def text(self, k: int) -> str:
        return self.toks[k].text if 0 <= k < len(self.toks) else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self.toks) and self.toks[k].kind == "word"

    def closing(self, k: int) -> int:
        """The place of the bracket that closes the one at k; the end where none does."""
        pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, 0
        left, right = self.text(k), pairs[self.text(k)]
        for j in range(k, len(self.toks)):
            if self.text(j) == left:
                depth += 1
            elif self.text(j) == right:
                depth -= 1
                if not depth:
                    return j
            elif left == "<" and self.text(j) in (";", "{", "}"):
                return k  # less than, not a list of types
        return len(self.toks)

    def chain_before(self, k: int, links: tuple[str, ...]) -> list[str]:
        """The words of a.b::c that end at k, in order."""
        parts, j = [self.text(k)], k
        while self.text(j - 1) in links and self.word(j - 2):
            parts.insert(0, self.text(j - 2))
            j -= 2
        if self.text(j - 1) in links:
            parts.insert(0, "")  # something that isn't a name
        return parts

    def chain_after(self, k: int, links: tuple[str, ...]) -> tuple[list[str], int]:
        """The words of a.b::c that start at k, and the place after them."""
        parts = [self.text(k)]
        k += 1
        while self.text(k) in links and self.word(k + 1):
            parts.append(self.text(k + 1))
            k += 2
        return parts, k


# Words that a bracket may follow without being called.
KEYWORDS = {
    "alignof", "as", "await", "case", "catch", "const", "const_cast", "constructor", "decltype", "delete", "do", "dynamic_cast", "else", "fn", "for", "function", "if", "import", "in",
    "let", "loop", "match", "move", "new", "noexcept", "of", "reinterpret_cast", "require", "return", "sizeof", "static_cast", "super", "switch", "throw", "typeof", "unsafe", "var", "while", "yield",
}
RUST_KEYWORDS = KEYWORDS - {"constructor", "delete", "function", "import", "new", "of", "require", "typeof"}


def c_facts(source: str, module: str) -> list[Fact]:
    """C and C++: includes, namespaces, classes, inline and out-of-line members, calls, throws."""
    includes = re.findall(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', source)
    r = Reader(module, tokens(re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.)*$", "", source, flags=re.S)))
    for path in includes:
        r.out.add(module, "imports", re.sub(r"\.[^./]+$", "", path).replace("../", "").replace("/", "."))
    methods: dict[str, set[str]] = {}

    def walk(emit: bool) -> None:
        stack, k = [Scope("namespace", module)], 0
        pending: Scope | None = None
        while k < len(r.toks):
            t, here = r.text(k), stack[-1]
            if t == "{":
                stack.append(pending or Scope("block", here.name, here.cls, here.func))
                pending = None
            elif t == "}":
                if len(stack) > 1:
                    stack.pop()
            elif t == ";":
                pending = None
            elif t == "namespace" and not here.func:
                parts, k = r.chain_after(k + 1, ("::",)) if r.word(k + 1) else ([], k + 1)
                pending = Scope("namespace", ".".join([here.name, *parts]))
                continue
            elif t in ("class", "struct") and r.word(k + 1) and not here.func and r.text(k - 1) not in ("enum", "<", ","):
                parts, j = r.chain_after(k + 1, ("::",))
                end = next((i for i in range(j, len(r.toks)) if r.text(i) in ("{", ";", "(", "=")), len(r.toks))
                if r.text(end) == "{":
                    name = ".".join([here.name, *parts])
                    if not emit:
                        r.names.setdefault(parts[-1], name)
                    else:
                        r.out.define(name, "Class")
                        i = j
                        while i < end:
                            if r.word(i) and r.text(i) not in ("public", "private", "protected", "virtual", "final"):
                                base, i = r.chain_after(i, ("::",))
                                r.out.add(name, "rdfs:subClassOf", resolved(".".join(base), r.names))
                                if r.text(i) == "<":
                                    i = max(i, r.closing(i))
                            else:
                                i += 1
                    pending = Scope("class", name, name)
                    k = end
                    continue
            elif t == "throw" and here.func and emit and r.word(k + 1):
                parts, _ = r.chain_after(k + 1, ("::",))
                r.out.add(here.func, "raises", resolved(".".join(parts), r.names))
                k += len(parts) * 2
                continue
            elif t == "(" and r.word(k - 1) and r.text(k - 1) not in KEYWORDS:
                close = r.closing(k)
                j = close + 1
                while r.text(j) in ("const", "noexcept", "override", "final"):
                    j += 1
                if r.text(j) == ":" and r.word(j + 1):  # a constructor's initialisers
                    while j < len(r.toks) and r.text(j) not in ("{", ";"):
                        j = r.closing(j) + 1 if r.text(j) in ("(", "[") else j + 1
                if r.text(j) == "->":
                    while j < len(r.toks) and r.text(j) not in ("{", ";"):
                        j += 1
                if not here.func and (r.text(j) == "{" or here.kind == "class" and r.text(j) in (";", "=")):
                    parts = r.chain_before(k - 1, ("::",))
                    cls = here.cls or (resolved(".".join(p for p in parts[:-1] if p), {p: f"{here.name}.{p}" for p in parts[:1]} | r.names) if len(parts) > 1 else "")
                    name = f"{cls or here.name}.{parts[-1]}"
                    methods.setdefault(cls, set()).add(parts[-1])
                    if emit and r.text(j) == "{" and r.text(k - 2) != "~":
                        r.out.define(name, "Function")
                    if r.text(j) == "{":
                        pending = Scope("function", here.name, cls, name)
                        k = j
                        continue
                elif here.func and emit:
                    parts = r.chain_before(k - 1, ("::", "->", "."))
                    declared = r.word(k - 2) and r.text(k - 2) not in KEYWORDS | {"co_return", "co_await"}
                    if not declared:
                        member = r.text(k - 2) in (".", "->")
                        if parts[0] == "this" and len(parts) == 2:
                            called = f"{here.cls}.{parts[1]}" if here.cls else parts[1]
                        elif member:
                            called = parts[-1]
                        elif len(parts) == 1 and parts[0] in methods.get(here.cls, ()):
                            called = f"{here.cls}.{parts[0]}"
                        else:
                            called = resolved(".".join(p for p in parts if p), r.names)
                        r.out.add(here.func, "calls", called)
            k += 1

    walk(False)
    walk(True)
    return r.out.rows()


def script_facts(source: str, module: str) -> list[Fact]:
    """TypeScript and JavaScript: imports, requires, classes, interfaces, functions, arrows, calls, new, throws."""
    r = Reader(module, tokens(source))
    for k, t in enumerate(r.toks):  # names that can be used before they are declared
        if t.text in ("class", "interface", "function") and r.word(k + 1) and r.text(k - 1) != ".":
            r.names.setdefault(r.text(k + 1), f"{module}.{r.text(k + 1)}")
        if t.text in ("const", "let", "var") and r.word(k + 1) and r.text(k + 2) == "=" and _arrow(r, k + 3):
            r.names.setdefault(r.text(k + 1), f"{module}.{r.text(k + 1)}")

    def specifier(text: str) -> str:
        path = text[1:-1]
        if not path.startswith("."):
            return path
        parts = module.split(".")[:-1]
        for step in re.sub(r"\.(?:[cm]?[jt]sx?)$", "", path).split("/"):
            if step == "..":
                parts = parts[:-1]
            elif step not in ("", "."):
                parts.append(step)
        return ".".join(parts)

    stack, k = [Scope("module", module)], 0
    pending: Scope | None = None
    while k < len(r.toks):
        t, here = r.text(k), stack[-1]
        if t == "{":
            stack.append(pending or Scope("block", here.name, here.cls, here.func))
            pending = None
        elif t == "}":
            if len(stack) > 1:
                stack.pop()
        elif t == "import" and not here.func and r.text(k + 1) != "(":
            j = k + 1
            bound: list[tuple[str, str]] = []
            while j < len(r.toks) and r.toks[j].kind != "string" and r.text(j) != ";":
                if r.word(j) and r.text(j) not in ("type", "from", "as"):
                    local = r.text(j + 2) if r.text(j + 1) == "as" else r.text(j)
                    bound.append((r.text(j), local))
                    j += 2 if r.text(j + 1) == "as" else 0
                elif r.text(j) == "*" and r.text(j + 1) == "as":
                    bound.append(("*", r.text(j + 2)))
                    j += 2
                j += 1
            if j < len(r.toks) and r.toks[j].kind == "string":
                target = specifier(r.text(j))
                r.out.add(module, "imports", target)
                for name, local in bound:
                    whole = name == "*" or (name == target.split(".")[-1] and r.text(k + 1) == name)
                    r.names[local] = target if whole else f"{target}.{name}"
            k = j
        elif t == "export" and r.text(k + 1) in ("*", "{"):
            j = next((i for i in range(k, min(len(r.toks), k + 200)) if r.toks[i].kind == "string" or r.text(i) == ";"), k)
            if r.toks[j].kind == "string" and r.text(j - 1) == "from":
                r.out.add(module, "imports", specifier(r.text(j)))
                k = j
        elif t == "require" and r.text(k + 1) == "(" and k + 2 < len(r.toks) and r.toks[k + 2].kind == "string":
            target = specifier(r.text(k + 2))
            r.out.add(module, "imports", target)
            if r.text(k - 1) == "=" and r.word(k - 2):
                r.names[r.text(k - 2)] = target
            k += 3
        elif t in ("class", "interface") and r.word(k + 1) and r.text(k - 1) != ".":
            name = f"{module}.{r.text(k + 1)}"
            r.out.define(name, "Class")
            j = k + 2
            while j < len(r.toks) and r.text(j) != "{":
                if r.text(j) == "<":
                    j = max(j, r.closing(j))
                elif r.word(j) and r.text(j) not in ("extends", "implements"):
                    parts, j = r.chain_after(j, (".",))
                    r.out.add(name, "rdfs:subClassOf", resolved(".".join(parts), r.names))
                    continue
                j += 1
            pending = Scope("class" if t == "class" else "interface", name, name)
            k = j
            continue
        elif t == "function" and (r.word(k + 1) or r.text(k + 1) == "*" and r.word(k + 2)) and not here.func:
            j = k + 1 if r.word(k + 1) else k + 2
            name = f"{module}.{r.text(j)}"
            r.out.define(name, "Function")
            k = _body(r, j + 1)
            if r.text(k) == "{":
                pending = Scope("function", here.name, "", name)
            continue
        elif t in ("const", "let", "var") and not here.func and not here.cls and r.word(k + 1) and r.text(k + 2) == "=" and _arrow(r, k + 3):
            name = f"{module}.{r.text(k + 1)}"
            r.out.define(name, "Function")
            j = next((i for i in range(k + 3, len(r.toks)) if r.text(i) == "=>"), len(r.toks))
            if r.text(k + 3) == "function" or r.text(k + 4) == "function":
                j = _body(r, k + 4) - 1
            if r.text(j + 1) == "{":
                pending = Scope("function", here.name, "", name)
                k = j + 1
                continue
            end = next((i for i in range(j, len(r.toks)) if r.text(i) == ";"), len(r.toks))
            _script_calls(r, j, end, Scope("function", here.name, "", name))
            k = end
        elif here.kind == "class" and t == "(" and r.word(k - 1) and r.text(k - 1) not in KEYWORDS - {"constructor"}:
            j = _body(r, k)
            if r.text(j) == "{":
                name = f"{here.cls}.{r.text(k - 1)}"
                r.out.define(name, "Function")
                pending = Scope("function", here.name, here.cls, name)
                k = j
                continue
            k = r.closing(k)
        elif here.func:
            _script_call(r, k, here)
        k += 1
    return r.out.rows()


def _arrow(r: Reader, k: int) -> bool:
    """Whether an arrow function or a function expression starts at k."""
    if r.text(k) == "async":
        k += 1
    if r.text(k) == "function":
        return True
    if r.text(k) == "(":
        j = r.closing(k) + 1
        while j < len(r.toks) and r.text(j) not in ("=>", ";", "{", ")"):
            j += 1
        return r.text(j) == "=>"
    return r.word(k) and r.text(k + 1) == "=>"


def _body(r: Reader, k: int) -> int:
    """The place after a parameter list and a result type: a brace, or what stands instead."""
    while k < len(r.toks) and r.text(k) != "(":
        k += 1
    j = r.closing(k) + 1
    if r.text(j) == ":":
        j += 1
        if r.text(j) == "{":
            j = r.closing(j) + 1
        while j < len(r.toks) and r.text(j) not in ("{", ";", "}"):
            j += 1
    return j


def _script_call(r: Reader, k: int, here: Scope) -> None:
    t = r.text(k)
    if t == "throw":
        at = k + 2 if r.text(k + 1) == "new" else k + 1
        if r.word(at):
            parts, _ = r.chain_after(at, (".",))
            r.out.add(here.func, "raises", resolved(".".join(parts), r.names))
    elif t == "new" and r.word(k + 1):
        parts, _ = r.chain_after(k + 1, (".",))
        if r.text(k - 1) != "throw":
            r.out.add(here.func, "calls", resolved(".".join(parts), r.names))
    elif t == "(" and r.word(k - 1) and r.text(k - 1) not in KEYWORDS:
        parts = r.chain_before(k - 1, (".",))
        first = k - 2 * len(parts) + 1
        if parts[0] and r.text(first - 1) not in ("new", "function"):
            names = r.names | ({"this": here.cls} if here.cls else {})
            r.out.add(here.func, "calls", resolved(".".join(parts), names))


def _script_calls(r: Reader, lo: int, hi: int, here: Scope) -> None:
    for k in range(lo, hi):
        _script_call(r, k, here)


def rust_facts(source: str, module: str) -> list[Fact]:
    """Rust: use trees, inline modules, types, traits, impls, functions, calls; macros are skipped."""
    r = Reader(module, tokens(source, rust=True))
    stack, k = [Scope("module", module)], 0
    pending: Scope | None = None

    def use(at: int, prefix: list[str]) -> int:
        """One use tree; returns the place after it."""
        parts = list(prefix)
        while r.word(at) or r.text(at) == "::":
            if r.word(at) and r.text(at) != "as":
                parts.append(r.text(at))
            elif r.text(at) == "as":
                break
            at += 1
        if r.text(at) == "{":
            at += 1
            while at < len(r.toks) and r.text(at) != "}":
                at = use(at, parts) if r.text(at) != "," else at + 1
            return at + 1
        if r.text(at) == "*":
            r.out.add(module, "imports", ".".join(parts))
            return at + 1
        if parts and parts[-1] == "self":
            parts = parts[:-1]
        local = parts[-1] if parts else ""
        if r.text(at) == "as":
            local, at = r.text(at + 1), at + 2
        if parts and parts != prefix:
            r.out.add(module, "imports", ".".join(parts))
            r.names[local] = ".".join(parts)
        return max(at, 1) if r.text(at) in (",", "}", ";") else at + 1

    # First the types and free functions, under their full names.
    depth: list[str] = [module]
    for i, t in enumerate(r.toks):
        if t.text == "{":
            depth.append(f"{depth[-1]}.{r.text(i - 1)}" if r.text(i - 2) == "mod" else depth[-1] + "\0")
        elif t.text == "}" and len(depth) > 1:
            depth.pop()
        elif t.text in ("struct", "enum", "union", "trait", "fn") and r.word(i + 1) and "\0" not in depth[-1]:
            r.names[r.text(i + 1)] = f"{depth[-1]}.{r.text(i + 1)}"
    while k < len(r.toks):
        t, here = r.text(k), stack[-1]
        if t == "{":
            stack.append(pending or Scope("block", here.name, here.cls, here.func))
            pending = None
        elif t == "}":
            if len(stack) > 1:
                stack.pop()
        elif t == ";":
            pending = None
        elif t == "use" and not here.func:
            k = use(k + 1, [])
            continue
        elif t == "mod" and r.word(k + 1):
            if r.text(k + 2) == "{":
                pending = Scope("module", f"{here.name}.{r.text(k + 1)}")
                k += 2
                continue
        elif t in ("struct", "enum", "union", "trait") and r.word(k + 1) and not here.func:
            name = f"{here.name}.{r.text(k + 1)}"
            r.out.define(name, "Class")
            j = k + 2
            if t == "trait" and r.text(j) == ":":
                while j < len(r.toks) and r.text(j) not in ("{", "where"):
                    if r.word(j):
                        parts, j = r.chain_after(j, ("::",))
                        r.out.add(name, "rdfs:subClassOf", resolved(".".join(parts), r.names))
                    else:
                        j += 1
            while j < len(r.toks) and r.text(j) not in ("{", ";", "("):
                j += 1
            if t == "trait":
                pending = Scope("class", here.name, name)
            elif r.text(j) == "{":
                j = r.closing(j) + 1  # fields and variants
            k = j
            continue
        elif t == "impl" and not here.func:
            j = k + 1
            if r.text(j) == "<":
                j = r.closing(j) + 1
            types: list[str] = []
            while j < len(r.toks) and r.text(j) not in ("{", "where", ";"):
                if r.text(j) == "<":
                    j = max(j, r.closing(j))
                elif r.word(j) and r.text(j) not in ("for", "dyn", "mut"):
                    parts, j = r.chain_after(j, ("::",))
                    types.append(".".join(parts))
                    continue
                j += 1
            while j < len(r.toks) and r.text(j) not in ("{", ";"):
                j += 1
            if types:
                cls = resolved(types[-1], r.names)
                cls = cls if cls != types[-1] or "." in cls else f"{here.name}.{cls}"
                if len(types) > 1:
                    r.out.add(cls, "rdfs:subClassOf", resolved(types[0], r.names))
                pending = Scope("class", here.name, cls)
            k = j
            continue
        elif t == "fn" and r.word(k + 1):
            name = f"{here.cls or here.name}.{r.text(k + 1)}"
            if not here.func:
                r.out.define(name, "Function")
            j = k + 2
            while j < len(r.toks) and r.text(j) not in ("{", ";"):
                j = r.closing(j) + 1 if r.text(j) in ("(", "[") else j + 1
            if r.text(j) == "{":
                pending = Scope("function", here.name, here.cls, here.func or name)
            k = j
            continue
        elif here.func and t.endswith("!") and r.word(k) and r.text(k + 1) in ("(", "[", "{"):
            k = r.closing(k + 1)
        elif here.func and t == "(" and r.word(k - 1) and r.text(k - 1) not in RUST_KEYWORDS:
            if r.text(k - 2) == ".":
                if r.text(k - 3) == "self" and here.cls:
                    r.out.add(here.func, "calls", f"{here.cls}.{r.text(k - 1)}")
            else:
                parts = r.chain_before(k - 1, ("::",))
                names = r.names | ({"Self": here.cls} if here.cls else {})
                r.out.add(here.func, "calls", resolved(".".join(p for p in parts if p), names))
        k += 1
    return r.out.rows()


READERS: dict[str, Callable[[str, str], list[Fact]]] = {
    ".py": python_facts,
    **dict.fromkeys((".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"), c_facts),
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), script_facts),
    ".rs": rust_facts,
}


def facts_of(path: str, module: str, source: str) -> list[Fact]:
    """The facts of one file; none if its kind is unknown or it can't be read."""
    reader = READERS.get("." + path.rsplit(".", 1)[-1])
    if reader is None:
        return []
    try:
        return reader(source, module)
    except (SyntaxError, ValueError, RecursionError):
        return []


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, module, source) of a tree's files of known kinds; hidden and vendored folders are left out.

    Python modules are named from the outermost package, other files from the root.
    A folder that driver and executors share is listed by name on the driver and
    read by the executors. In any other store Spark's own reader lists it, which
    leaves out names that begin with an underscore.
    """
    suffixes = "|".join(s[1:] for s in READERS)
    skipped = "|".join(VENDORED)
    wanted = F.rlike("path", F.lit(rf"\.({suffixes})$")) & ~F.rlike("path", F.lit(rf"(^|/)(\.[^/]*|{skipped})/")) & ~F.rlike("path", F.lit(r"(^|/)\.[^/]*$"))
    if re.match(r"file:|(?![A-Za-z][\w+.-]*:)", root):
        top = os.path.abspath(re.sub(r"^file:(//)?", "", root))
        names = [os.path.relpath(os.path.join(folder, f), top) for folder, folders, found in os.walk(top) for f in found]
        listed = spark.createDataFrame([(n,) for n in sorted(names)], "path string").where(wanted)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = []
                for name in batch["path"]:
                    with open(os.path.join(top, name), encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                yield batch.assign(source=texts)

        files = listed.mapInPandas(read, "path string, source string")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
        files = found.select(inside.alias("path"), F.col("content").cast("string").alias("source")).where(wanted)
    return files.select("path", module_of(F.col("path")).alias("module"), "source")


def module_of(path: Column) -> Column:
    """A dotted name from a path: other characters than letters, digits, _ and - become _; a package's own file names the package."""
    plain = F.regexp_replace(path, r"\.[^./]+$", "")
    parts = F.transform(F.split(plain, "/"), lambda p: F.regexp_replace(p, r"(?U)[^\w-]", "_"))
    dotted = F.array_join(parts, ".")
    return F.when(F.endswith(path, F.lit(".py")), F.regexp_replace(dotted, r"\.__init__$", "")).otherwise(dotted)


def facts(files: DataFrame) -> DataFrame:
    """(path, s, p, o) of files (path, module, source): each file's facts, whole, in a task of its own batch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(f.path, *fact) for f in batch.itertuples(index=False) if f.source is not None for fact in facts_of(f.path, f.module, f.source)]
            yield pd.DataFrame(out, columns=["path", "s", "p", "o"])

    return files.select("path", "module", "source").mapInPandas(rows, "path string, s string, p string, o string")


def as_triples(found: DataFrame) -> DataFrame:
    """Facts as terms of a graph."""
    term = lambda c: F.when(F.rlike(c, F.lit(r"^(rdf|rdfs|owl|xsd):")), F.col(c)).otherwise(F.concat(F.lit("ns:"), F.col(c)))
    return found.select(*[term(c).alias(c) for c in ("s", "p", "o")]).distinct()
