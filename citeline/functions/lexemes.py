"""Tokens of a text as a full-text index without stemming keeps them.

Beside plain words there are kinds that stay whole: e-mail addresses, hosts, URLs,
version numbers, decimals and signed whole numbers. A hyphenated compound and a URL
are kept whole and in parts, each part with a position of its own, so that
``turn-off`` is found by the compound and by ``off``. Error codes like ``E-18`` are
a word and a signed number, as the part behind the hyphen has no letter.

One regular expression names the kinds in the order in which they are tried, all in
the JVM; what a match holds tells its kind. It needs no look-around, so engines
without it give the same tokens. Labels of a host behind the first begin with a
letter, and parts of a compound behind the first have one. It follows the documented kinds of tokens, and does
not claim to cut every odd string as a particular parser does.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = r"[\p{L}\p{N}]"


def kinds(hold: str = "+") -> dict[str, str]:
    """The kinds in the order in which they are tried, as patterns.

    ``hold`` follows what never has to give back a character it took: "+" makes that
    possessive, which Java needs for long texts; engines without back-tracking take "".
    Labels of hosts have at most eight parts, and names in front of an @ 64 characters,
    so that no start of a token looks further ahead than that.
    """
    run, h = f"{_ALNUM}+{hold}", hold
    more = f"(?:-{run}){{0,7}}{h}"
    host = rf"{run}{more}(?:\.\p{{L}}[\p{{L}}\p{{N}}]*{h}{more})+{h}"
    return {
        "email": rf"{_ALNUM}[\p{{L}}\p{{N}}._+-]{{0,63}}{h}@{run}{more}(?:\.{run}{more})+{h}",
        "protocol": rf"\p{{L}}+{h}://",
        "url": rf'{host}(?::[0-9]+{h})?/[^\x00-\x20<>"]*{h}',
        "host": host,
        "version": rf"[0-9]+{h}(?:\.[0-9]+{h}){{2,}}{h}",
        "decimal": rf"[+-]?[0-9]+{h}\.[0-9]+{h}(?:e[+-]?[0-9]+{h})?",
        "compound": rf"{run}(?:-\p{{N}}*{h}\p{{L}}[\p{{L}}\p{{N}}]*{h})+{h}",
        "signed": rf"[+-][0-9]+{h}",
        "word": run,
    }


def pattern(hold: str = "+") -> str:
    """All kinds as one expression."""
    return "|".join(kinds(hold).values())


def _kept(token: Column) -> Column:
    """What a match is indexed as: itself and its parts; a protocol is nothing."""
    slash = F.instr(token, "/")
    whole = F.array(token)
    url = F.array(token, F.substring(token, F.lit(1), slash - 1), F.substring(token, slash, F.length(token)))
    one = F.contains(token, F.lit("@")) | ~token.rlike(r"[-/]") | token.rlike(r"^[+-]")
    return (
        F.when(F.endswith(token, F.lit("://")), F.filter(whole, lambda _: F.lit(False)))
        .when(F.contains(token, F.lit("/")) & ~F.contains(token, F.lit("@")), url)
        .when(one | F.contains(token, F.lit(".")), whole)
        .otherwise(F.concat(whole, F.split(token, "-", -1)))
    )


def lexemes(text: Column) -> Column:
    """Lower-cased tokens in the order of their positions, the first being 1.

    A null text gives null, an empty one no tokens.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern()), F.lit(0))
    return F.flatten(F.transform(found, _kept))


def query_lexemes(question: Column) -> Column:
    """Distinct tokens of a question, sorted."""
    return F.array_sort(F.array_distinct(lexemes(question)))


def vector(tokens: Column) -> Column:
    """``lexeme:1,7`` for each different token with its positions, sorted and joined
    by spaces: tokens with positions are sorted once, and runs of a token joined."""
    at = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"))))

    def shown(sorted_at):
        return F.transform(
            sorted_at,
            lambda p, j: F.concat(
                F.when(F.get(sorted_at, j - 1)["t"].eqNullSafe(p["t"]), F.lit(",")).otherwise(
                    F.concat(F.when(j > 0, F.lit(" ")).otherwise(F.lit("")), p["t"], F.lit(":"))
                ),
                p["i"].cast("string"),
            ),
        )

    return F.array_join(F.get(F.transform(F.array(at), shown), F.lit(0)), "")
