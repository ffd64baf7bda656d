"""The Python chunker, on the standard library's syntax trees."""

from __future__ import annotations

import ast

from sparkloom.sources.code.common import chunk, remainder

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _span(node: ast.AST, starts: list[int], data: bytes) -> tuple[int, int]:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    return starts[first - 1], starts[node.end_lineno - 1] + node.end_col_offset


def dependencies(tree: ast.Module) -> list[str]:
    """Imported modules in order; of relative imports with their dots."""
    out: dict[str, None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out.setdefault(a.name)
        elif isinstance(node, ast.ImportFrom):
            out.setdefault("." * node.level + (node.module or ""))
    return list(out)


def _parameters(a: ast.arguments) -> list[dict]:
    star = [ast.arg("*" + a.vararg.arg, a.vararg.annotation)] if a.vararg else []
    kw = [ast.arg("**" + a.kwarg.arg, a.kwarg.annotation)] if a.kwarg else []
    return [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else ""} for x in [*a.posonlyargs, *a.args, *star, *a.kwonlyargs, *kw]]


def _yields(node: ast.AST) -> bool:
    """A yield of the function itself, not of one declared in it."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Yield, ast.YieldFrom)):
            return True
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(n)
    return False


def python(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    data = text.encode()
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    deps, out, spans = dependencies(tree), [], []

    def code_of(span: tuple[int, int]) -> str:
        return data[span[0] : span[1]].decode()

    def kinds(node) -> list[str]:
        return [ast.unparse(t) for t in getattr(node, "type_params", [])]

    def visit(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, FUNCTIONS):
                span = _span(n, starts, data)
                out.append(chunk(
                    path, "Python", "method" if owner else "function", code_of(span), deps, n.name, class_name=owner, function_name=n.name, parameters=_parameters(n.args), return_type=ast.unparse(n.returns) if n.returns else None,
                    decorators=[ast.unparse(d) for d in n.decorator_list], type_parameters=kinds(n), is_method=owner is not None, is_async=isinstance(n, ast.AsyncFunctionDef), is_generator=_yields(n),
                ))
                spans.append(span)
                visit(n, None)
            elif isinstance(n, ast.ClassDef):
                span = _span(n, starts, data)
                fields = [x for x in n.body if isinstance(x, (ast.AnnAssign, ast.Assign))]
                properties = [{"name": ast.unparse(t), "type": ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else ""} for x in fields for t in ([x.target] if isinstance(x, ast.AnnAssign) else x.targets)]
                head = data[span[0] : starts[n.body[0].lineno - 1]].decode() if n.body[0].lineno > n.lineno else code_of(span)
                doc = n.body[0] if isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str) else None
                body = [code_of((starts[x.lineno - 1], starts[x.end_lineno - 1] + x.end_col_offset)) for x in ([doc] if doc else []) + fields]
                out.append(chunk(path, "Python", "class", "\n".join([head.rstrip(), *body]), deps, n.name, class_name=n.name, properties=properties, bases=[ast.unparse(b) for b in [*n.bases, *n.keywords]], decorators=[ast.unparse(d) for d in n.decorator_list], type_parameters=kinds(n)))
                spans.append(span)
                visit(n, n.name)
            elif isinstance(n, ast.TypeAlias) or isinstance(n, ast.AnnAssign) and n.value is not None and ast.unparse(n.annotation).rpartition(".")[2] == "TypeAlias":
                name = ast.unparse(n.name if isinstance(n, ast.TypeAlias) else n.target)
                span = _span(n, starts, data)
                out.append(chunk(path, "Python", "type_alias", code_of(span), deps, name, class_name=owner, alias_name=name, alias_target=ast.unparse(n.value), type_parameters=kinds(n), is_type_alias=True))
                spans.append(span)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, ast.Lambda):
                name = ast.unparse(n.target if isinstance(n, ast.AnnAssign) else n.targets[0])
                span = _span(n, starts, data)
                out.append(chunk(path, "Python", "lambda", code_of(span), deps, name, class_name=owner, function_name=name, parameters=_parameters(n.value.args), is_method=owner is not None, is_async=False, is_generator=False))
                spans.append(span)
            else:
                visit(n, owner)

    visit(tree, None)
    # Spans are in bytes; cut them from the bytes and read the rest as text.
    rest = remainder(data.decode("latin-1"), spans).encode("latin-1").decode()
    return out + ([chunk(path, "Python", "remainder", rest, deps)] if rest else [])
