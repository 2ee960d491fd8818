"""White space beside a space is found without a pattern, whatever the white space is."""

from __future__ import annotations

import re
import sys

from millrace.llm import token_files


def test_texts_with_white_space_beside_a_space_are_told_apart():
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if re.match(r"\s", c)} == {" ", *token_files._BLANKS}
    pattern = re.compile(r"\s | \s")
    for c in [*token_files._BLANKS, " ", "\0", "x", "é", "\u200b"]:
        for text in (c, f"a{c}b", f"a{c} b", f"a {c}b", f"a b{c}", f"{c} ", f" {c}", f"a{c}b c"):
            assert token_files._irregular(text) == bool(pattern.search(text))
