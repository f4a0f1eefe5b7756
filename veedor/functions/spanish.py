"""Spanish word stems after the published Snowball algorithm, and stop words."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the algorithm, as its description lists them.
VOWELS = set("aeiouáéíóúü")
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
PLAIN_GERUNDS = "ando iendo ar er ir".split()
STANDARD = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
    "log": "logía logías".split(),
    "u": "ución uciones".split(),
    "ente": "encia encias".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": "idad idades".split(),
    "iva": "iva ivo ivas ivos".split(),
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()
PLAIN = str.maketrans("áéíóú", "aeiou")
#: Words that carry no topic: articles, prepositions, pronouns and forms of the commonest verbs.
STOP = frozenset(
    (
        "a al algo algunas algunos ante antes aquel aquella aquellas aquellos así aún aunque bajo bien cada como con contra cual cuales cuando cuanto "
        "de del desde donde durante e el él ella ellas ellos en entre era eran eres es esa esas ese eso esos esta está están estas este esto estos "
        "fue fueron ha hace hacia han hasta hay he la las le les lo los más me mi mis mientras mucho muchos muy nada ni no nos nosotros nuestra nuestro "
        "o os otra otras otro otros para pero poco por porque pues que qué quien quienes se sea sean según ser será si sí sido sin sino sobre solo son "
        "soy su sus también tan tanto te tiene tienen toda todas todo todos tras tu tus un una unas uno unos usted ustedes vosotros y ya yo"
    ).split()
)


def longest(word: str, endings: list[str]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def after_pair(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    first, second = word[0] in VOWELS, word[1] in VOWELS
    if not second or first:  # after the next vowel, or after the next consonant
        wanted = not second
        return next((i + 1 for i in range(2, len(word)) if (word[i] in VOWELS) == wanted), len(word))
    return 3


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word.  A very long word is cut like any other; an empty one stays empty."""
    rv, r1 = verb_region(word), after_pair(word, 0)
    r2 = after_pair(word, r1)
    inside = lambda w, ending, region: len(w) - len(ending) >= region
    # A pronoun at the end of a verb form.
    if (pronoun := longest(word, PRONOUNS)) and inside(word, pronoun, rv):
        body = word[: -len(pronoun)]
        accented, plain = longest(body, list(GERUNDS)), longest(body, PLAIN_GERUNDS)
        if accented and inside(body, accented, rv):
            word = body[: -len(accented)] + GERUNDS[accented]
        elif plain and inside(body, plain, rv) or body.endswith("uyendo") and inside(body, "yendo", rv):
            word = body
    done = standard(word, r1, r2)
    if done is None:
        done = verbal(word, rv)
    return residual(word if done is None else done, rv).translate(PLAIN)


def standard(word: str, r1: int, r2: int) -> str | None:
    """The word without its suffix, or None if it has none that may go."""
    kind, ending = max(((k, longest(word, endings)) for k, endings in STANDARD.items()), key=lambda x: len(x[1]))
    if not ending or len(word) - len(ending) < (r1 if kind == "amente" else r2):
        return None
    word = word[: -len(ending)]

    def without(*before: str) -> str:
        found = longest(word, list(before))
        return word[: -len(found)] if found and len(word) - len(found) >= r2 else word

    if kind in ("log", "u", "ente"):
        return word + kind
    if kind == "ic":
        return without("ic")
    if kind == "mente":
        return without("ante", "able", "ible")
    if kind == "idad":
        return without("abil", "ic", "iv")
    if kind == "iva":
        return without("at")
    if kind == "amente":
        shorter = without("iv", "os", "ic", "ad")
        if shorter != word and word.endswith("iv"):
            word = shorter
            return without("at")
        return shorter
    return word


def verbal(word: str, rv: int) -> str | None:
    region = word[rv:]
    if (ending := longest(region, Y_VERBS)) and word[: -len(ending)].endswith("u"):
        return word[: -len(ending)]
    if ending := longest(region, E_VERBS + VERBS):
        word = word[: -len(ending)]
        return word[:-1] if ending in E_VERBS and word.endswith("gu") else word
    return None


def residual(word: str, rv: int) -> str:
    region = word[rv:]
    if ending := longest(region, RESIDUAL):
        return word[: -len(ending)]
    if region and region[-1] in "eé":
        word = word[:-1]
        return word[:-1] if word.endswith("gu") and len(word) > rv else word
    return word
