"""Stemming of Russian words as column expressions, by the published Snowball rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels and endings of the published algorithm, as text; after: only behind а or я.
VOWELS = "аеиоуыэюя"
GERUND_AFTER, GERUND = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
REFLEXIVE = "ся сь"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_AFTER, PARTICIPLE = "ем нн вш ющ щ", "ивш ывш ующ"
VERB_AFTER = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
DERIVED = "ост ость"
SUPERLATIVE = "ейш ейше"


def _ending(plain: str = "", after: str = "") -> str:
    """A pattern of the longest of the endings at a word's end (a search from the left finds it first)."""
    parts = [f"(?:{'|'.join(plain.split())})"] if plain else []
    return "(?:" + "|".join([f"(?<=[ая])(?:{'|'.join(after.split())})"] * bool(after) + parts) + ")$"


def russian(word: Column) -> Column:
    """The stem of a lower-case word with е for ё; words in other letters have no such vowel and stay.

    Endings are taken off the part behind the first vowel; derivational ones only off the region behind the
    second vowel-consonant change. The steps nest as expressions, so a column of words needs no UDF.
    """
    head = F.regexp_extract(word, f"^[^{VOWELS}]*[{VOWELS}]", 0)
    tail = F.substr(word, F.length(head) + 1)
    second = F.length(F.regexp_extract(word, f"^.*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]", 0))
    off = lambda c, *ends: F.regexp_replace(c, _ending(*ends), "")

    def first(t: Column) -> Column:
        gerund = off(t, GERUND, GERUND_AFTER)
        base = off(t, REFLEXIVE)
        adjective, verb = off(base, ADJECTIVE), off(base, VERB, VERB_AFTER)
        rest = F.when(adjective != base, off(adjective, PARTICIPLE, PARTICIPLE_AFTER)).when(verb != base, verb).otherwise(off(base, NOUN))
        return F.when(gerund != t, gerund).otherwise(rest)

    t = F.regexp_replace(first(tail), "и$", "")
    cut = off(t, DERIVED)
    t = F.when((cut != t) & (second > 0) & (F.length(head) + F.length(cut) >= second), cut).otherwise(t)
    superlative = off(t, SUPERLATIVE)
    t = F.when((superlative != t) | t.endswith("нн"), F.regexp_replace(superlative, "нн$", "н")).otherwise(F.regexp_replace(t, "ь$", ""))
    return F.when(head == "", word).otherwise(F.concat(head, t))
