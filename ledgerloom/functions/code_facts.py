"""Facts about one Python function, read from its syntax tree."""

from __future__ import annotations

import ast

from ledgerloom.fixed_values import RECEIVERS, STDLIB_MODULES

SCOPES = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef))
#: Nodes without children that matter here, by far the most of a tree.
LEAVES = frozenset(
    [ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias]
    + [kind for group in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for kind in group.__subclasses__()]
)


class _Body:
    """Yields, returned values and raised names of one function, not of those defined inside it, and names that calls anywhere begin with. Code may nest to any depth."""

    def __init__(self, fn: ast.AST) -> None:
        self.yields = self.returns = False
        self.raises: set[str] = set()
        self.bases: set[str] = set()
        nested: list[ast.AST] = []
        self._pass([fn], nested)
        self._pass(nested, None)

    def _pass(self, waiting: list[ast.AST], nested: list[ast.AST] | None) -> None:
        """All nodes under the waiting ones; functions and classes below go to ``nested``, where it is given, and are not noted further."""
        while waiting:
            node = waiting.pop()
            for field in node._fields:
                value = getattr(node, field, None)
                for child in value if value.__class__ is list else (value,):
                    kind = child.__class__
                    if kind in LEAVES or not isinstance(child, ast.AST):
                        continue
                    if kind is ast.Call:
                        func = child.func
                        if func.__class__ is ast.Attribute and func.value.__class__ is ast.Name:
                            self.bases.add(func.value.id)
                    if nested is None:
                        waiting.append(child)
                    elif kind in SCOPES:
                        nested.append(child)
                    else:
                        self._note(child)
                        waiting.append(child)

    def _note(self, node: ast.AST) -> None:
        if isinstance(node, (ast.Yield, ast.YieldFrom)):
            self.yields = True
        elif isinstance(node, ast.Return) and node.value is not None:
            self.returns |= not (isinstance(node.value, ast.Constant) and node.value.value is None)
        elif isinstance(node, ast.Raise):
            target = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
            name = getattr(target, "attr", None) or getattr(target, "id", None)
            if name:
                self.raises.add(name)


def code_facts(code: str) -> dict:
    """The facts as a row; ``error`` is set, and the rest empty, when ``code`` is not exactly one function."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as exc:
        return {"error": str(exc)}
    except (RecursionError, MemoryError):
        return {"error": "code is nested too deeply to parse"}
    if len(tree.body) != 1 or not isinstance(tree.body[0], (ast.FunctionDef, ast.AsyncFunctionDef)):
        return {"error": "code must be exactly one top-level function"}
    fn = tree.body[0]
    spec = fn.args
    plain = [a.arg for a in spec.posonlyargs + spec.args]
    params = plain[1:] if plain and plain[0] in RECEIVERS else plain[:]
    params += [spec.vararg.arg] if spec.vararg else []
    params += [a.arg for a in spec.kwonlyargs]
    params += [spec.kwarg.arg] if spec.kwarg else []
    body = _Body(fn)
    return {
        "name": fn.name,
        "params": params,
        "first_arg": spec.args[0].arg if spec.args else None,
        "is_async": isinstance(fn, ast.AsyncFunctionDef),
        "is_generator": body.yields,
        "returns_value": body.returns,
        "raises": sorted(body.raises),
        "has_docstring": ast.get_docstring(fn) is not None,
        "code_lines": sum(1 for line in code.splitlines() if line.strip()),
        "modules": sorted(body.bases.intersection(STDLIB_MODULES)),
        "error": None,
    }
