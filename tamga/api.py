"""The engine for single words in Python: arguments are checked, errors are Python's own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tamga import kernel, tables


def _text(value: object, name: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string, not {type(value).__name__}")
    return value


class Shaper:
    """Shapes and canonical spellings of one locale."""

    def __init__(self, locale: str = tables.LOCALE):
        if _text(locale, "locale") != tables.LOCALE:
            raise ValueError(f"unsupported locale {locale!r}")
        self.locale = locale
        self.version, self.canonical_version = tables.VERSION, tables.CANONICAL_VERSION

    def shape(self, word: str) -> list[str]:
        return list(kernel.shape(_text(word, "word")))

    def shape_raw(self, word: str) -> list[str]:
        return list(kernel.shape_raw(_text(word, "word")))

    def shape_str(self, word: str) -> str:
        return "+".join(self.shape(word))

    def same_shape(self, a: str, b: str) -> bool:
        return self.shape(a) == self.shape(b)

    def shape_detailed(self, word: str) -> list[dict]:
        return kernel.detail(_text(word, "word"))

    def trace(self, word: str) -> dict:
        return kernel.trace(_text(word, "word"))

    def rule_names(self) -> list[str]:
        return list(tables.RULES)

    def known_written_units(self) -> list[str]:
        return sorted(tables.catalogue().known)

    def positioned_written_units(self) -> list[tuple[str, str]]:
        return sorted(tables.catalogue().positioned)

    def normalize(self, word: str, allow_fallback: bool = False) -> str:
        return kernel.normalize(_text(word, "word"), bool(allow_fallback))

    def normalize_text(self, text: str, allow_fallback: bool = False) -> str:
        return kernel.normalize_text(_text(text, "text"), bool(allow_fallback))

    def parse_written_units(self, text: str) -> list[str]:
        return list(kernel.parse_units(_text(text, "text")))

    def normalize_written_units(self, units: Sequence[str]) -> str:
        if isinstance(units, (str, bytes)) or not isinstance(units, Sequence):
            raise TypeError("written_units must be a sequence of strings")
        return kernel.encode_units(tuple(_text(u, f"written_units[{i}]") for i, u in enumerate(units)))

    def normalize_positioned_written_units(self, records: Sequence[Mapping[str, str]]) -> str:
        try:
            return kernel.encode_records(records)
        except kernel.WordError as e:
            if e.error_class == "RecordType":
                raise TypeError(str(e)) from None
            raise
