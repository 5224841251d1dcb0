"""Code maps of the accident table, with a default for unknown codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published meaning of the accident codes.
CODES: dict[str, tuple[dict[int, str], str]] = {
    "accident_type": (
        {
            1: "Zusammenstoß mit anfahrendem/anhaltendem/ruhendem Fahrzeug",
            2: "Zusammenstoß mit vorausfahrendem/wartendem Fahrzeug",
            3: "Zusammenstoß mit seitlich in gleicher Richtung fahrendem Fahrzeug",
            4: "Zusammenstoß mit entgegenkommendem Fahrzeug",
            5: "Zusammenstoß mit einbiegendem/kreuzendem Fahrzeug",
            6: "Zusammenstoß zwischen Fahrzeug und Fußgänger",
            7: "Aufprall auf Fahrbahnhindernis",
            8: "Abkommen von Fahrbahn nach rechts",
            9: "Abkommen von Fahrbahn nach links",
            0: "Unfall anderer Art",
        },
        "Unbekannte Unfallart",
    ),
    "weekday": ({1: "Sonntag", 2: "Montag", 3: "Dienstag", 4: "Mittwoch", 5: "Donnerstag", 6: "Freitag", 7: "Samstag"}, "Unbekannter Wochentag"),
    "month": (
        {1: "Januar", 2: "Februar", 3: "März", 4: "April", 5: "Mai", 6: "Juni", 7: "Juli", 8: "August", 9: "September", 10: "Oktober", 11: "November", 12: "Dezember"},
        "Unbekannter Monat",
    ),
    "category": ({1: "Unfall mit Getöteten", 2: "Unfall mit Schwerverletzten", 3: "Unfall mit Leichtverletzten"}, "Unbekannte Unfallkategorie"),
    "type1": (
        {1: "Fahrunfall", 2: "Abbiegeunfall", 3: "Einbiegen / Kreuzen-Unfall", 4: "Überscheiten-Unfall", 5: "Unfall durch ruhenden Verkehr", 6: "Unfall im Längsverkehr", 7: "sonstiger Unfall"},
        "Unbekannte Unfallart",
    ),
    "light": ({0: "Tageslicht", 1: "Dämmerung", 2: "Dunkelheit"}, "Unbekannte Lichtverhältnisse"),
    "surface": ({0: "trocken", 1: "nass/feucht/schlüpfrig", 2: "winterglatt"}, "Unbekannte Straßenverhältnisse"),
    "plausibility": (
        {
            1: "Erfolgreiche Plausibilisierung des Unfallortes nach regulärem Verfahren",
            2: "Erfolgreiche Plausibilisierung des Unfallortes nach erweitertem Verfahren für Unfälle mit Fahrradbeteiligung",
        },
        "Unbekannte Plausibilität",
    ),
}
# Hours up to 18 are written with a colon, later ones with a point.
CODES["hour"] = ({h: f"{h:02d}{':' if h < 19 else '.'}00 - {h + 1:02d}{':' if h < 19 else '.'}00" for h in range(24)}, "Unbekannte Uhrzeit")


def mapped(kind: str, code: Column) -> Column:
    """The text of a code, the kind's default for unknown codes and nulls."""
    table, default = CODES[kind]
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, code.cast("int")), F.lit(default))


#: column, text: participants of an accident in the order they are listed. Fixed values.
PARTICIPANTS = [("IstRad", "Fahrrad"), ("IstPKW", "PKW"), ("IstFuss", "Fußgänger"), ("IstGkfz", "Güterkraftfahrzeug"), ("IstSonstige", "Sonstige")]


def participants(pairs: list[tuple[Column, str]], sep: str = ", ") -> Column:
    """Names whose flag holds, joined in order."""
    return F.concat_ws(sep, *[F.when(flag, F.lit(name)) for flag, name in pairs])
