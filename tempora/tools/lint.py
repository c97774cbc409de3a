"""A linter for look-ahead in feature code: it reads the source, it does not run it."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from pathlib import Path

# What each rule says.
RULES = {
    "L001": ("reads a later row", "shift by a positive number of rows, or declare the shift inside a window"),
    "L002": ("uses statistics of the whole series", "use rolling or expanding statistics, or fit on a training part"),
    "L003": ("fills forward without a limit", "give a limit"),
    "L004": ("joins on the filing date", "join on the time at which the filing was known"),
    "L005": ("a window frame reaches past the current row", "end the frame at the current row"),
}
WINDOWED = {"rolling", "expanding", "ewm"}
SCALAR = {"statistics", "math", "np", "numpy", "F", "fmean"}
EXEMPT = {"argv", "args", "parts", "path", "paths", "lines", "names", "shape", "columns", "tokens", "words", "split", "parents", "text", "line"}
TRAINING = ("train", "training", "in_sample", "insample")


@dataclass(frozen=True, order=True)
class Finding:
    lineno: int
    col_offset: int
    rule: str
    message: str
    advice: str
    snippet: str


def _negative(node: ast.expr | None) -> bool:
    return isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float))


def _name(node: ast.expr) -> str:
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Call):
        return _name(node.func)
    if isinstance(node, ast.Subscript):
        return _name(node.value)
    return ""


def _chain(node: ast.expr) -> list[str]:
    """Names along a chain of attributes, calls and subscripts, last first."""
    out = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            out.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            if isinstance(node, ast.Name):
                out.append(node.id)
            return out


class _Visitor(ast.NodeVisitor):
    def __init__(self, source: str):
        self.lines, self.found, self.windowed = source.splitlines(), [], set()

    def add(self, rule: str, node: ast.AST) -> None:
        snippet = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
        self.found.append(Finding(node.lineno, node.col_offset, rule, *RULES[rule], snippet))

    def visit_Call(self, node: ast.Call) -> None:
        name = _name(node.func)
        options = {k.arg: k.value for k in node.keywords}
        if name == "over":  # shifts inside a window are declared
            self.windowed |= {id(n) for a in [node.func, *node.args, *options.values()] for n in ast.walk(a)}
        if name in ("shift", "lag", "lead") and id(node) not in self.windowed:
            steps = [*node.args[: 2 if name != "shift" else 1], *(options.get(k) for k in ("n", "periods", "offset"))]
            if any(_negative(a) for a in steps):
                self.add("L001", node)
        if name in ("mean", "std", "fit") and isinstance(node.func, ast.Attribute):
            chain = _chain(node.func.value)
            whole = not WINDOWED & set(chain) and not (SCALAR & set(chain[-1:]))
            named = " ".join([*chain, *(_name(a) for a in node.args)]).lower()
            if whole and not any(t in named for t in TRAINING):
                self.add("L002", node)
        if name in ("ffill", "forward_fill") and not node.args and "limit" not in options:
            self.add("L003", node)
        if name in ("join", "merge", "join_asof", "merge_asof"):
            given = [options.get(k) for k in ("on", "left_on", "right_on")] + (node.args[1:2] if name == "join" else [])
            if any(isinstance(c, ast.Constant) and c.value == "filing_date" for g in given if g is not None for c in ast.walk(g)):
                self.add("L004", node)
        if name in ("rowsBetween", "rangeBetween") and len(node.args) == 2:
            end = node.args[1]
            if _name(end) == "unboundedFollowing" or (isinstance(end, ast.Constant) and isinstance(end.value, int) and end.value > 0):
                self.add("L005", node)
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        index = node.slice
        bounds = [index.lower, index.upper] if isinstance(index, ast.Slice) else [index]
        if any(_negative(b) for b in bounds) and not EXEMPT & set(_chain(node.value)):
            self.add("L001", node)
        self.generic_visit(node)


def lint_source(source: str, filename: str = "<string>") -> list[Finding]:
    """Findings by line and column."""
    visitor = _Visitor(source)
    visitor.visit(ast.parse(source, filename))
    return sorted(visitor.found)


def lint_file(path: str | Path) -> list[Finding]:
    path = Path(path)
    return lint_source(path.read_text(encoding="utf-8"), str(path))
