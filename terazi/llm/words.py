"""Words and their codes, as the operators of this subpackage share them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

_WORD = re.compile(r"[^\W_]+")
#: Look-alikes of Latin letters in Cyrillic and Greek (fixed values).
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌ" + "аеѕіјорсухһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ονϲϳ",
        "ABESIJKMHOPCTYXYG" + "aesijopcyxhdqw" + "ABEZHIKMNOPTYX" + "ovcj",
        strict=True,
    )
)


def turkish_lower(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased the Turkish way."""
    return _WORD.findall(turkish_lower(text))


class Codes(dict):
    """Words as 64-bit numbers, with a bounded memory of the words seen."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as one Arrow list column."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.array([], np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind))
