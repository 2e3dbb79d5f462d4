"""Other printed names of a required document, the same on every run; references to forms are never touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .names import canonical_form, normalise_name, normalised

# Words that a bidder puts in place of others, tried in this order.
SUBSTITUTIONS: list[tuple[str, str]] = [
    (r"\bdeclaration\b", "undertaking"),
    (r"\bproof of\b", "documentary evidence of"),
    (r"\bcompletion certificates?\b", "certificates of satisfactory completion"),
    (r"\bwork orders?\b", "purchase orders placed on us"),
    (r"\bexperience\b", "past performance record"),
    (r"\btest report\b", "type test report"),
    (r"\bcompliance sheet\b", "clause-wise compliance statement"),
    (r"\bletter of bid\b", "bid submission letter"),
    (r"\bcovering letter\b", "forwarding letter"),
    (r"\bauthori[sz]ation to represent\b", "letter authorising the signatory of"),
    (r"\bfinancial status\b", "financial position"),
    (r"\bbalance sheets?\b", "statement of assets and liabilities"),
    (r"\bincome tax returns?\b", "IT returns"),
    (r"\bregistration\b", "enrolment"),
    (r"\bannual turnover\b", "yearly revenue"),
    (r"\bnet worth\b", "shareholders' funds"),
    (r"\bchartered accountant\b", "statutory auditor"),
    (r"\bsolvency certificate\b", "banker's solvency letter"),
    (r"\bdigital signature certificate\b", "class III DSC token certificate"),
    (r"\bbid securing\b", "bid security"),
    (r"\bearnest money deposit\b", "bid security deposit"),
    (r"\bmanufacturers? authori[sz]ation\b", "OEM authorisation"),
    (r"\btechnical specification\b", "technical datasheet"),
    (r"\blitigation\b", "pending court cases"),
    (r"\bkey personnel\b", "deployed technical staff"),
    (r"\bkey equipment\b", "plant and machinery"),
    (r"\bshareholding\b", "share capital"),
    (r"\bno deviation\b", "nil deviation"),
    (r"\bintegrity pact\b", "integrity agreement"),
    (r"\bpass-?phrase\b", "decryption passphrase"),
]
# A name of the form "X of Y", and the forms that a bidder copies as they are printed.
OF_PHRASE = r"(?i)^(.{3,40}?)\s+of\s+(?:the\s+)?(.{3,60})$"
FORM_REFERENCE = r"(?i)\b(?:form|annexure|appendix|schedule|proforma|format)\b[\s:.\-]*(?:no\.?\s*)?[A-Z0-9][A-Z0-9\-./]*"
STYLES = ["as_printed", "alias", "reworded"]


def headed(name: str) -> str:
    """A name as a heading prints it."""
    return name.title().replace("Gst", "GST").replace("Pan", "PAN")


def other_names() -> dict[str, list[tuple[str, str]]]:
    """Canonical name to its names as (normalised, as a heading prints it), itself first."""
    return {c: [(normalised(n), headed(n)) for n in [c, *aliases]] for c, aliases in V.DOCUMENT_ALIASES.items()}


def swapped(name: Column) -> Column:
    """The first other name of the same document, or null for a document that the table does not know."""
    current, table = normalise_name(name), []
    for canonical, names in other_names().items():
        table += [F.lit(canonical), F.array(*(F.struct(F.lit(plain).alias("plain"), F.lit(said).alias("said")) for plain, said in names))]
    known = F.try_element_at(F.create_map(*table), canonical_form(current))
    return F.get(F.filter(known, lambda a: a["plain"] != current), 0)["said"]


def reworded(name: Column) -> Column:
    """The name with the first substitution that changes what it normalises to, or else its two halves around "of" the other way round.

    Null where neither applies, and for a name that quotes a numbered form.
    """
    before = normalise_name(name)
    tries = [F.when(name.rlike("(?i)" + said), F.regexp_replace(name, rf"(?is)^(.*?){said}", "$1" + meant)) for said, meant in SUBSTITUTIONS]
    whole = F.trim(name)
    flipped = F.when(whole.rlike(OF_PHRASE), F.concat(F.trim(F.regexp_extract(whole, OF_PHRASE, 2)), F.lit(" "), F.trim(F.regexp_extract(whole, OF_PHRASE, 1))))
    other = F.filter(F.array_compact(F.array(*tries, flipped)), lambda c: normalise_name(c) != before)
    return F.when(~name.rlike(FORM_REFERENCE), F.get(other, 0))


def renamed(name: Column, style: Column) -> Column:
    """The name in a style: an alias or else reworded, reworded or else an alias, or as it is printed."""
    return F.when(style == "alias", F.coalesce(swapped(name), reworded(name), name)).when(style == "reworded", F.coalesce(reworded(name), swapped(name), name)).otherwise(name)
