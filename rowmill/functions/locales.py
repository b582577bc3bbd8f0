"""Cultures: separators and date patterns. Fixed values of the supported ones; any other is an error."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Locale:
    name: str
    decimal: str
    group: str
    #: Date patterns with a year, most usual first, as format strings; leading zeros are optional.
    dates: tuple[str, ...]
    #: Names of months, full and short.
    months: tuple[tuple[str, ...], ...]
    #: Time patterns besides H:mm and H:mm:ss.
    times: tuple[str, ...] = ()


# fixed values
ENGLISH = (
    ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
)
GERMAN = (
    ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    ("Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"),
)
FRENCH = (
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."),
)
TURKISH = (
    ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"),
    ("Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara"),
)
# names of weekdays from Sunday, full and short
ENGLISH_DAYS = (("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"), ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))
GERMAN_DAYS = (("Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"), ("So", "Mo", "Di", "Mi", "Do", "Fr", "Sa"))
FRENCH_DAYS = (("dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi"), ("dim.", "lun.", "mar.", "mer.", "jeu.", "ven.", "sam."))
TURKISH_DAYS = (("Pazar", "Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi"), ("Paz", "Pzt", "Sal", "Çar", "Per", "Cum", "Cmt"))
DAYS = {"de-DE": GERMAN_DAYS, "fr-FR": FRENCH_DAYS, "tr-TR": TURKISH_DAYS}
LOCALES = {
    "": Locale("", ".", ",", ("MM/dd/yyyy", "yyyy-MM-dd", "dd MMMM yyyy", "yyyy MMMM"), ENGLISH),
    "en-US": Locale("en-US", ".", ",", ("M/d/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "d MMMM, yyyy", "MMMM yyyy"), ENGLISH, ("h:mm tt", "h:mm:ss tt")),
    "en-GB": Locale("en-GB", ".", ",", ("dd/MM/yyyy", "yyyy-MM-dd", "dd MMMM yyyy", "d MMMM yyyy", "MMMM yyyy"), ENGLISH),
    "de-DE": Locale("de-DE", ",", ".", ("dd.MM.yyyy", "yyyy-MM-dd", "d. MMMM yyyy", "MMMM yyyy"), GERMAN),
    "fr-FR": Locale("fr-FR", ",", "\u202f", ("dd/MM/yyyy", "yyyy-MM-dd", "d MMMM yyyy", "MMMM yyyy"), FRENCH),
    "tr-TR": Locale("tr-TR", ",", ".", ("d.MM.yyyy", "d MMMM yyyy", "yyyy-MM-dd", "MMMM yyyy"), TURKISH),
}


def days_of(where: Locale) -> tuple[tuple[str, ...], ...]:
    """Names of weekdays from Sunday, full and short."""
    return DAYS.get(where.name, ENGLISH_DAYS)


def locale(name: str | None) -> Locale:
    try:
        return LOCALES[name or ""]
    except KeyError:
        raise ValueError(f"Culture '{name}' is not supported.") from None
