"""Languages of tracks: canonical codes, lists, and which tracks to remove."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from itertools import product
from string import ascii_lowercase

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ISO 639-2 bibliographic codes and their terminology codes.
BIBLIOGRAPHIC = {"alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho", "cze": "ces", "dut": "nld", "fre": "fra", "geo": "kat", "ger": "deu", "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri", "may": "msa", "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym"}
# ISO 639-1 codes that were withdrawn, which Java still lists.
WITHDRAWN = ("bh", "in", "iw", "ji", "mo")


# ISO 639-2 codes that stand for no single language: groups of languages, several, none.
COLLECTIVE = (
    "afa alg apa art ath aus bad bai bat ber bih bnt btk cai cau cel cmc cpe cpf cpp crp cus day dra fiu gem him ijo inc ine ira iro kar khi kro map mis mkh mno mul mun myn nah nai nic nub oto paa phi pra "
    "roa sai sal sem sgn sio sit sla smi son ssa tai tup tut und wak wen ypk znd zxx"
).split()
# ISO 639-2 codes that are younger than Java's table.
LATER = ("cnr", "zgh")


@cache
def iso_codes() -> dict[str, str]:
    """Every ISO 639-1, bibliographic and terminology code of a single language to its terminology code.

    They come from the tables that Java has itself: a code of three letters is known if Java has a name for it without
    regard to any locale. This asks for each once in a session, which takes a few seconds.
    """
    locale = SparkSession.active()._jvm.java.util.Locale
    two = {code: locale(code).getISO3Language() for code in locale.getISOLanguages() if code not in WITHDRAWN}
    threes = ("".join(x) for x in product(ascii_lowercase, repeat=3))
    three = [c for c in threes if c not in COLLECTIVE and c not in BIBLIOGRAPHIC and locale(c).getDisplayLanguage(locale.ROOT) not in (c, two.get(c))]
    return two | BIBLIOGRAPHIC | {c: c for c in (*two.values(), *BIBLIOGRAPHIC.values(), *three, *LATER)}


def canonical(code: Column) -> Column:
    """The terminology code; null for what isn't a known language, such as und or mul."""
    return canonical_with()(code)


def canonical_with(more: Sequence[str] = ()) -> Callable[[Column], Column]:
    """``canonical`` that also knows the given terminology codes."""
    known = iso_codes() | {c.lower(): c.lower() for c in more}
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in known.items())), F.lit(","), F.lit(":"))  # folded to a literal
    return lambda code: F.try_element_at(table, F.lower(F.trim(code)))


def parse_list(codes: Sequence[str], more: Sequence[str] = ()) -> list[str] | None:
    """Canonical codes, each once; null if any is unknown."""
    known = iso_codes() | {c.lower(): c.lower() for c in more}
    found = [known.get(c.strip().lower()) for c in codes if c.strip()]
    return None if None in found else list(dict.fromkeys(found))


def track_removals(languages: Column, keep: Sequence[str], guard: bool = True) -> Column:
    """Positions, from 0, of tracks in a known language that isn't kept.

    With guard, as for audio, none is removed if no track is in a kept language. Null languages are not probed: null.
    """
    kept = parse_list(keep)
    if not kept:
        return F.when(languages.isNotNull(), F.array().cast("array<int>"))
    known = F.transform(languages, canonical)
    wanted = F.array(*[F.lit(k) for k in kept])
    marked = F.transform(known, lambda x, i: F.when(x.isNotNull() & ~F.array_contains(wanted, x), i))
    removed = F.filter(marked, lambda x: x.isNotNull())
    return F.when(F.arrays_overlap(F.filter(known, lambda x: x.isNotNull()), wanted), removed).when(languages.isNotNull(), F.array().cast("array<int>")) if guard else removed
