"""Codecs by name, with their parameters."""

from __future__ import annotations

import copy
from typing import Any

from nearloom.operators.codecs.camel import CamelDecoder, CamelEncoder
from nearloom.operators.codecs.dexor import DeXorDecoder, DeXorEncoder
from nearloom.operators.codecs.elf import ElfDecoder, ElfEncoder
from nearloom.operators.codecs.gorilla import GorillaDecoder, GorillaEncoder

CODECS = {
    "Gorilla": (GorillaEncoder, GorillaDecoder),
    "Elf": (ElfEncoder, ElfDecoder),
    "Camel": (CamelEncoder, CamelDecoder),
    "DeXOR": (DeXorEncoder, DeXorDecoder),
}


def parse_config(text: str | None) -> dict[str, int]:
    """``{buffer_bits:3,rho:8}`` as a dict."""
    inside = (text or "").strip().strip("{}").strip()
    return {k.strip(): int(v) for k, v in (p.split(":", 1) for p in inside.split(",") if p.strip())}


def _make(which: int, algorithm: str, config: str | dict[str, int] | None, data_type: str) -> Any:
    if data_type != "Double" or algorithm not in CODECS:
        raise ValueError(f"no codec {algorithm!r} for {data_type!r}")
    return CODECS[algorithm][which](**(parse_config(config) if config is None or isinstance(config, str) else config))


def encoder(algorithm: str, config: str | dict[str, int] | None = None, data_type: str = "Double") -> Any:
    return _make(0, algorithm, config, data_type)


def decoder(algorithm: str, config: str | dict[str, int] | None = None, data_type: str = "Double") -> Any:
    return _make(1, algorithm, config, data_type)


def copied(coder: Any) -> Any:
    """An encoder or decoder of its own in the state of ``coder``: for coding on trial."""
    return copy.deepcopy(coder)


def stated(coder: Any) -> str:
    """The state of an encoder or decoder, which are the same after the same values; a ring of values begins with its oldest."""
    own = dict(vars(coder))
    if "known" in own:
        own |= {"known": own["known"][own["place"] :] + own["known"][: own["place"]], "place": 0}
    return repr(sorted(own.items()))
