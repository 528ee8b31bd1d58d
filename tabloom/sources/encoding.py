"""Which encoding bytes are in, and how Python and Spark name it."""

from __future__ import annotations

from dataclasses import dataclass

# Byte order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-bom"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
NAMES = ("utf-8", "utf-8-bom", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "latin-1", "windows-1252", "unknown")
ALIASES = {
    "utf8": "utf-8", "utf8bom": "utf-8-bom", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "utf16": "utf-16-le", "utf32le": "utf-32-le", "utf32be": "utf-32-be", "utf32": "utf-32-le",
    "latin1": "latin-1", "iso88591": "latin-1", "windows1252": "windows-1252", "cp1252": "windows-1252", "win1252": "windows-1252", "ascii": "utf-8", "usascii": "utf-8",
}
CODECS = {"utf-8-bom": "utf-8", "windows-1252": "cp1252"}
SAMPLE = 1 << 16


@dataclass(frozen=True)
class Encoding:
    name: str
    mark: int = 0
    confidence: float = 1.0

    @property
    def transcodes(self) -> bool:
        return self.name not in ("utf-8", "utf-8-bom")

    @property
    def wide(self) -> int:
        return 4 if "32" in self.name else 2 if "16" in self.name else 1


def encoding_name(name: str) -> str:
    """A name of NAMES, whatever the case, hyphens and underscores."""
    found = ALIASES.get("".join(c for c in name.lower() if c.isalnum()))
    if not found:
        raise ValueError(f"no such encoding: {name}")
    return found


def detect_encoding(data: bytes) -> Encoding:
    """By its mark; else by where null bytes lie; else UTF-8 if valid; else a one-byte encoding."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return Encoding(name, len(mark))
    sample = data[:SAMPLE]
    if len(sample) >= 4 and b"\0" in sample:
        n = len(sample) // 4
        zeros = [sum(sample[i + k] == 0 for i in range(0, 4 * n, 4)) / n for k in range(4)]
        for name, high in (("utf-32-le", (1, 2, 3)), ("utf-32-be", (0, 1, 2))):
            if all(zeros[k] > 0.6 for k in high) and all(zeros[k] < 0.3 for k in range(4) if k not in high):
                return Encoding(name, 0, 0.85)
        odd, even = (zeros[1] + zeros[3]) / 2, (zeros[0] + zeros[2]) / 2
        if odd > 0.3 and even < 0.1:
            return Encoding("utf-16-le", 0, 0.8)
        if even > 0.3 and odd < 0.1:
            return Encoding("utf-16-be", 0, 0.8)
    try:
        data.decode("utf-8")
        return Encoding("utf-8")
    except UnicodeDecodeError as e:
        if e.start >= len(data) - 3 and e.reason == "unexpected end of data":  # the sample ends inside a character
            return Encoding("utf-8")
    return Encoding("windows-1252" if any(0x80 <= b <= 0x9F for b in sample) else "latin-1", 0, 0.6)


def decode(data: bytes, encoding: Encoding) -> str:
    """Text without its mark; what can't be decoded becomes U+FFFD."""
    return data[encoding.mark :].decode(CODECS.get(encoding.name, encoding.name), "replace")
