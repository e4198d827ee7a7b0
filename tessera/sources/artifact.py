"""Compiled contracts as bytes: JSON with the document, the data's columns and
pins.  Another format or version, or a changed function, is refused."""

from __future__ import annotations

import json

from ..compiler import VERSION, Compiled, compile_contract
from ..document import Reader, digest
from ..errors import fail
from ..functions.registry import Registry

FORMAT = "tessera-compiled/1"


def to_bytes(c: Compiled) -> bytes:
    body = {"format": FORMAT, "compiler": VERSION, "document": c.doc.plain(), "rule_layers": [r.layer for r in c.doc.rules], "layers": c.doc.layers, "source": {k: list(v) for k, v in c.source.items()}, "pins": c.pins, "hash": c.hash, "tiers": c.tiers}
    return json.dumps(body | {"check": digest(body)}, sort_keys=True, separators=(",", ":")).encode()


def from_bytes(data: bytes, registry: Registry | None = None) -> Compiled:
    body = json.loads(data)
    if body.get("format") != FORMAT or body.get("compiler") != VERSION:
        raise fail("document", f"not a {FORMAT} contract of {VERSION}")
    check = body.pop("check", None)
    if check != digest(body):
        raise fail("document", "the compiled contract is damaged")
    registry = registry or Registry()
    registry.verify(body["pins"])
    doc = Reader(json.dumps(body["document"])).document()
    out = compile_contract(doc, {k: tuple(v) for k, v in body["source"].items()}, registry)
    for r, layer in zip(out.doc.rules, body["rule_layers"]):
        r.layer = layer
    if out.hash != body["hash"]:
        raise fail("document", "the contract compiles to another hash")
    return out
