"""Token ids of whole texts by the tokenizers library, remembered per word."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import islice

from tokenizers import Tokenizer

from . import common


#: A letter or digit followed by a symbol: the lexer parts them anyway, so a space between them changes no id.
_BORDER = re.compile(rb"(?<=[a-z0-9])[.,;:!?*#$%&]")


def simplify(data: bytes) -> bytes:
    """The same ids from fewer distinct units: letters lower-cased as the normaliser does, symbols set apart from words.
    Left alone where that could matter: near special strings, and with combining marks (lead bytes CC and CD), which
    compose with some lower-case letters only."""
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data
    return _BORDER.sub(rb" \g<0>", data.lower())


#: Units that one worker remembers with their ids, some 200 bytes each.
MAX_UNITS = 1_200_000


class IdEncoder:
    """Encodes texts to little-endian 32-bit ids.

    The vocabulary's normaliser turns ASCII white space into word borders and drops it, and no token or special
    string holds any, so a text's ids are those of its units between ASCII spaces, in order. Each distinct unit
    goes through the library once (while the memo holds it)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") is None or not any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", [])):
            raise ValueError("ids per unit need a lower-casing vocabulary with end-of-word marks")
        self.library = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes."""
        if len(self.memo) > MAX_UNITS:
            self.memo.clear()
        memo, out = self.memo, []
        for data in texts:
            units = simplify(data).split()
            new = iter(set(units).difference(memo))
            own = {}
            while part := list(islice(new, 4096)):
                encoded = self.library.encode_batch_fast([u.decode("utf-8", "replace") for u in part], add_special_tokens=False)
                for unit, e in zip(part, encoded):
                    (memo if len(unit) <= common.MEMO_UNIT_BYTES else own)[unit] = array("I", e.ids).tobytes()
            out.append(b"".join([memo[u] if u in memo else own[u] for u in units]) if own else b"".join(map(memo.__getitem__, units)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)
