"""All queries of this subpackage, by name."""

from __future__ import annotations

from loomgraph.llm import chats, encodings, groups, languages, mixing, neardups, neighbours, pieces, tokens

_MODULES = [groups, pieces, chats, tokens, mixing, neardups, neighbours, encodings, languages]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
