"""The gate of the disguise scan against its transducer, over all of Unicode."""

import sys
import unicodedata

import pytest

from unitwise.llm import pii


def test_gate_and_transducer_agree():
    named = {*pii._INVISIBLE, *pii._DASHES, *pii._DOTS, *pii._LOOKALIKE}
    for c in map(chr, range(sys.maxunicode + 1)):
        tape = pii.Tape(c)
        pii._fold_characters(tape)
        k, d = unicodedata.normalize("NFKC", c), unicodedata.digit(c, None)
        plain = c.isascii() or not (len(k) == 1 and k.isascii() or d is not None and not k.isascii() or c in named)
        assert (pii._ODD.search(c) is None) == (tape.text == c) == plain


def digits(number, zero):
    return "".join(chr(zero + int(c)) if c.isdigit() else c for c in number)


@pytest.mark.parametrize(
    ("text", "kind"),
    [(digits("4041894974608795", zero), "card") for zero in (0x0E50, 0x09E6, 0x0BE6)]
    + [("".join(chr(0x2460 + int(c) - 1) if c != "0" else "\u24ea" for c in "4041894974608795"), "card"), (digits("+15552019876", 0x0E50), "phone"), ("jo\ufe6bmail.org", "email"), ("jo@mail\ufe52org", "email"), ("jo\u212f@mail.org", "email")],
)
def test_other_disguises_are_found(text, kind):
    for around in ("{}", "see {} now", "no\u00a0break {} now"):
        whole = around.format(text)
        base, every = pii.spans(whole)
        added = [(k, whole[s:e]) for s, e, k in every if (s, e, k) not in base]
        assert added == [(kind, text)]
        assert pii.masked(whole) == around.format(f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "email",
    [
        "a.b.c.d.e.f at example dot com",
        " dot ".join("abcdefgh") + " at " + " dot ".join(["mail"] * 9) + " dot org",
        "x" * 65 + " at example dot com",
        "x" * 5000 + " [at] " + "y" * 100 + " (dot) com",
    ],
)
def test_disguised_names_of_any_length(email):
    text = f"write to {email} now"
    base, every = pii.spans(text)
    assert not base
    assert [(k, text[s:e]) for s, e, k in every] == [("email", email)]


@pytest.mark.parametrize("part", ["a dot ", "a at ", "a . ", " ", "one ", "(at) ", "[.]a", "a @ b.", "1 dot "])
def test_disguise_scan_is_linear(part):
    import time

    def seconds(n):
        t = time.process_time()
        pii.spans(part * n)
        return time.process_time() - t

    seconds(1000)
    assert seconds(64_000) < 40 * max(seconds(8_000), 2e-3)
