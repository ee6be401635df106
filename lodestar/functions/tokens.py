"""Tokens of a text with their kinds and positions, as a text-search parser tells them.

Kinds: ``email``, ``url`` (host and path), ``host``, ``path``, ``version`` (1.2.3), ``float``, ``int``, ``hyphenated`` (a word of several parts, followed by these) and ``word``.
A URL is three tokens: itself without its scheme, its host and its path; a hyphenated word is itself and its parts. Every token has
a position of its own, from 1; stop words keep theirs and are no lexemes, so that phrases know of the gap. All in small letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.arrays import let
from lodestar.functions.text import ENGLISH_STOP, search_text

EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
HOST = r"(?:[\p{L}\p{N}][\p{L}\p{N}-]*\.)+[\p{L}]{2,}"
PATH = r"(?:/[^\s<>\"']*[^\s<>\"'.,;:!?)])"
SCHEME = r"(?:https?|ftp)://"
VERSION, FLOAT, INT = r"[0-9]+(?:\.[0-9]+){2,}", r"[0-9]+\.[0-9]+", r"[0-9]+"
WORD = r"[\p{L}\p{N}]+"
HYPHENATED = rf"{WORD}(?:-{WORD})+"
#: The first of these that fits where a token begins is the token.
TOKEN = f"{EMAIL}|(?:{SCHEME})?{HOST}{PATH}?|{VERSION}|{FLOAT}|{HYPHENATED}|{WORD}"
#: The same to an engine that can look ahead. Most tokens are a run of letters and digits after which nothing stands that could go on with it: they are told at once,
#: and an address's first part is not given back letter by letter, as no letter of it is an @.
FAST_TOKEN = rf"[\p{{L}}\p{{N}}]++(?![_%+@-]|://|\.[\p{{L}}\p{{N}}._%+@-])|{TOKEN.replace('+@', '++@', 1)}"
#: Kind by what a whole token is like, in this order.
KINDS = {"email": EMAIL, "url": f"(?:{SCHEME})?{HOST}{PATH}", "host": f"(?:{SCHEME})?{HOST}", "version": VERSION, "float": FLOAT, "int": INT, "hyphenated": HYPHENATED}


def _kind(token: Column) -> Column:
    out = F.lit("word")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(F.regexp_like(token, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    # All other kinds have a sign or begin with a digit.
    return F.when(F.regexp_like(token, F.lit(r"^\p{L}[\p{L}\p{N}]*+$")), "word").otherwise(out)


def _each(token: Column) -> Column:
    """A token and what it consists of."""
    one = lambda text, kind: F.struct(text.alias("token"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))

    def of(kind: Column) -> Column:
        bare = F.regexp_replace(token, f"^{SCHEME}", "")
        host, path = F.regexp_extract(bare, "^([^/]*)", 1), F.regexp_extract(bare, "(/.*)$", 1)
        whole = F.array(one(F.when(kind == "host", bare).otherwise(token), kind))
        parts = F.transform(F.split(token, "-"), lambda p: one(p, "word"))
        return F.when(kind == "url", F.array(one(bare, "url"), one(host, "host"), one(path, "path"))).when(kind == "hyphenated", F.concat(whole, parts)).otherwise(whole)

    return let(_kind(token), of)


def tokens(text: Column) -> Column:
    """Array of (token, kind, pos)."""
    found = F.regexp_extract_all(F.lower(search_text(text)), F.lit(FAST_TOKEN), F.lit(0))
    every = F.flatten(F.transform(found, _each))
    return F.transform(every, lambda t, i: F.struct(t["token"].alias("token"), t["kind"].alias("kind"), (i + 1).alias("pos")))


def positioned(text: Column) -> Column:
    """The same without stop words."""
    return F.filter(tokens(text), lambda t: ~((t["kind"] == "word") & t["token"].isin(*ENGLISH_STOP)))
