"""Text helpers: stripping, tokens, citations' normal forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text (Unicode, and the separators U+001C to U+001F).
SPACE = r"[\s\u0085\p{Z}\x1c-\x1f]"

# Words without weight in the lexical index, as text.
STOPWORDS = frozenset(
    """
    и в во не что он на я с со как а то все она так его но да ты к у же вы за
    бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну
    вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там
    потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была
    сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому
    этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были
    куда зачем всех никогда можно при наконец два об другой хоть после над больше
    тот через эти нас про всего них какая много разве три эту моя впрочем хорошо
    свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно
    всю между также г гг настоящего настоящему настоящим
    """.split()
)
# Fixed patterns: words of two letters or more; numbers of acts and of clauses.
WORDS_RU_LATIN, WORDS_ANY = "[а-яёa-z]{2,}", r"\p{L}{2,}"
CODES = r"[0-9]+(?:[-./][\p{L}\p{N}_]+)+|[0-9]{2,}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column, words: str = WORDS_ANY, stopwords: frozenset[str] = STOPWORDS, stem=None) -> Column:
    """Words without stopwords, stemmed by stem (Column -> Column) if given, then codes as they stand."""
    low = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    found = F.regexp_extract_all(low, F.lit(words), F.lit(0))
    if stopwords:
        found = F.filter(found, lambda w: ~w.isin(*sorted(stopwords)))
    if stem:
        found = F.transform(found, stem)
    return F.concat(found, F.regexp_extract_all(low, F.lit(CODES), F.lit(0)))


def without_fence(text: Column) -> Column:
    """A model's JSON answer without the ``` fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
