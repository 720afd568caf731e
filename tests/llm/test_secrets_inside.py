"""Keys that stand inside longer runs or over several lines."""

import base64
import random

import pytest

from lodestone.llm import secrets


def element(tag, data):
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + data


draw = random.Random(9)
RSA = element(0x30, element(2, b"\0") + b"".join(element(2, bytes([1]) + draw.randbytes(n)) for n in (128, 3, 127, 64, 64, 64, 64, 63)))
EC = element(0x30, element(2, b"\1") + element(4, draw.randbytes(32)) + element(0xA0, element(6, b"\x2a\x86\x48\xce\x3d\3\1\7")))
field = lambda x: len(x).to_bytes(4, "big") + x
SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(draw.randbytes(51)) + field(draw.randbytes(136))


def wrapped(text, width, by="\n"):
    return by.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("key", [RSA, EC, SSH])
def test_keys_inside(key):
    code = base64.b64encode(key).decode()
    bare = code.rstrip("=")
    forms = [code, f"path/{code}", f"key_{code}", f"x-{bare}-tail", f"\\n{code}", "0x" + key.hex(), "ab" + key.hex() + "00", key.hex().upper()]
    forms += [wrapped(code, w, by) for w in (64, 76) for by in ("\n", "\r\n", "\\n", "\n  ", "\n> ")]
    forms += [f"-----BEGIN PRIVATE KEY-----\n{wrapped(code, 64)}\nmore text", f"-----BEGIN PRIVATE KEY-----\\n{wrapped(code, 64, chr(92) + 'n')}"]
    for form in forms:
        if key is SSH and "=" not in form and bare not in form and len(form) == 2 * len(key) + (form[1] == "x") * 2 + (form[:2] == "ab") * 4:
            continue  # OpenSSH keys are not looked for in hex
        text = f"see {form} end"
        found = [(a, b) for a, b, kind in secrets.confirmed_spans(text) if kind == "key"]
        assert len(found) == 1, form
        start, end = found[0]
        said = text[start:end].replace("\\n", "")
        said = "".join(c for c in said if c not in "\r\n >")
        assert said.rstrip("=").lower() in (bare.lower(), key.hex()), form


def test_cut_or_changed_keys_are_none():
    code = base64.b64encode(RSA[:-20]).decode()
    assert secrets.confirmed_spans(f"see {wrapped(code, 64)} end") == []
    assert secrets.confirmed_spans("see 0x" + RSA.hex()[:-2] + " end") == []
