"""Float64 codecs for ordered series: Gorilla, Elf, Camel and DeXOR."""

from nearloom.operators.codecs.registry import CODECS, copied, decoder, encoder, parse_config

__all__ = ["CODECS", "copied", "decoder", "encoder", "parse_config"]
