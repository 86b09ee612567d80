"""Club and player name keys."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

#: Spellings (lower case) of club names and the canonical one.
CLUB_ALIASES = {
    "hull": "Hull City", "hull city": "Hull City", "ipswich": "Ipswich Town", "ipswich town": "Ipswich Town", "coventry": "Coventry City",
    "coventry city": "Coventry City", "manchester city": "Man City", "man city": "Man City", "manchester united": "Man Utd", "man utd": "Man Utd",
    "man u": "Man Utd", "newcastle united": "Newcastle", "newcastle": "Newcastle", "nottingham forest": "Nott'm Forest", "nott'm forest": "Nott'm Forest",
    "nforest": "Nott'm Forest", "tottenham": "Spurs", "tottenham hotspur": "Spurs", "spurs": "Spurs", "wolverhampton wanderers": "Wolves",
    "wolverhampton": "Wolves", "wolves": "Wolves", "west bromwich albion": "West Brom", "west brom": "West Brom", "west ham united": "West Ham",
    "west ham": "West Ham", "sheffield united": "Sheffield Utd", "sheffield utd": "Sheffield Utd", "leicester city": "Leicester", "leicester": "Leicester",
    "norwich city": "Norwich", "norwich": "Norwich", "swansea city": "Swansea", "swansea": "Swansea", "stoke city": "Stoke", "stoke": "Stoke",
    "brighton and hove albion": "Brighton", "brighton & hove albion": "Brighton", "brighton": "Brighton", "cardiff city": "Cardiff", "cardiff": "Cardiff",
    "huddersfield town": "Huddersfield", "huddersfield": "Huddersfield", "leeds united": "Leeds", "leeds": "Leeds", "burnley fc": "Burnley",
    "burnley": "Burnley", "middlesbrough": "Middlesbrough", "sunderland": "Sunderland", "southampton": "Southampton", "watford": "Watford", "luton": "Luton",
    "luton town": "Luton", "arsenal": "Arsenal", "aston villa": "Aston Villa", "bournemouth": "Bournemouth", "afc bournemouth": "Bournemouth",
    "brentford": "Brentford", "chelsea": "Chelsea", "crystal palace": "Crystal Palace", "everton": "Everton", "fulham": "Fulham", "liverpool": "Liverpool",
}


def club(name: Column) -> Column:
    """Canonical club name; an unknown one is only trimmed, null is empty."""
    table = F.create_map(*[F.lit(x) for pair in CLUB_ALIASES.items() for x in pair])
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(trimmed), r"\s+", " ")), trimmed)


def _folder() -> Callable[[str | None], str]:
    """The fold of a name. Made in a function, it is sent to workers by value, and they need not import this package."""

    def fold(name: str | None) -> str:
        import re
        import unicodedata

        plain = unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode().lower()
        return " ".join(re.sub("[^a-z0-9 ]+", " ", plain).split())

    return fold


#: Decomposed, what is not ASCII dropped, lower case, punctuation to blanks, blanks collapsed.
player_key_of = _folder()


def player_key(name: Column) -> Column:
    """Join key of a player's name. ASCII names stay in the JVM; only others go through Python."""
    one = player_key_of

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: one(n or ""))

    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(F.coalesce(name, F.lit("")).rlike(r"^\p{ASCII}*$"), plain).otherwise(F.pandas_udf(fold, "string")(name))


def split_trailing_id(name: Column) -> tuple[Column, Column]:
    """("A_B_376") to ("A B", 376); without a trailing number, the name with blanks and null."""
    number = F.regexp_extract(name, r".+_(\d+)$", 1)
    return F.trim(F.translate(F.regexp_replace(name, r"(?<=.)_\d+$", ""), "_", " ")), number.try_cast("bigint")


def position_label(label: Column) -> Column:
    """One spelling of the archive's positions: every keeper is GK."""
    upper = F.upper(F.trim(label))
    return F.when(upper.isin("GKP", "GOALKEEPER", "GK"), "GK").otherwise(upper)
