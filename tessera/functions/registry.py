"""Functions that rules may call: the closed list of built-ins, and functions of
owners, pinned by the hash of body and signature.

An owner's function has an SQL body over its parameter names, which Catalyst
inlines, and may have a Python twin for the interpreter.  Null in, null out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import fail

SCALARS = ("bool", "int", "uint", "double", "string", "bytes", "timestamp", "duration")


@dataclass(frozen=True)
class Function:
    name: str
    args: tuple[str, ...]
    result: str
    body: str = ""
    owner: str = "core"
    deterministic: bool = True
    twin: Callable | None = field(default=None, compare=False)

    @property
    def pin(self) -> str:
        what = [self.name, list(self.args), self.result, self.body, self.owner, self.deterministic]
        return hashlib.sha256(json.dumps(what, separators=(",", ":")).encode()).hexdigest()


BUILTIN = (
    Function("hash_sha256", ("string",), "string"), Function("hash_sha256", ("bytes",), "string"), Function("redact", ("string",), "string"),
    Function("partial", ("string", "int"), "string"), Function("is_msisdn", ("string",), "bool"), Function("is_email", ("string",), "bool"),
)


def signature(text: str) -> tuple[str, tuple[str, ...], str]:
    """``name(type, type) -> type``"""
    m = re.fullmatch(r"\s*([a-z][a-z0-9_]*)\s*\(([^)]*)\)\s*->\s*(\S+)\s*", text)
    ok = lambda t: t in SCALARS or re.fullmatch(r"embedding<\d+>", t)
    args = tuple(a.strip() for a in m[2].split(",") if a.strip()) if m else ()
    if not m or not all(map(ok, (*args, m[3]))):
        raise fail("document", f"not a signature: `{text}`")
    return m[1], args, m[3]


class Registry:
    def __init__(self, functions=BUILTIN):
        self.functions = list(functions)

    def add(self, text: str, body: str, owner: str, deterministic: bool = True, twin: Callable | None = None) -> Function:
        name, args, result = signature(text)
        if any(f.name == name and f.owner == "core" for f in self.functions):
            raise fail("document", f"`{name}` is a built-in function")
        f = Function(name, args, result, body, owner, deterministic, twin)
        self.functions.append(f)
        return f

    def visible_to(self, owner: str | None) -> "Registry":
        return Registry([f for f in self.functions if f.owner in ("core", owner)])

    def verify(self, pins: dict[str, str]) -> None:
        """Refuse if a function that was pinned is gone or changed."""
        now = {f.pin for f in self.functions}
        for name, pin in pins.items():
            if pin not in now:
                raise fail("unknown_function", f"`{name}` is not the function that the contract was compiled with")
