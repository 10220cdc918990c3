"""Rules for the corpus that the jobs are made for, and a small set for the test tables.

All tables of this module are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DefinitionRules:
    """What marks a definition; words are folded, and markers are beginnings of words."""

    interrogative: tuple[str, ...]
    question_word: str  # makes ``question_pair`` an interrogative
    question_pair: str
    predicate: tuple[str, ...]
    named: str  # the whole word right behind the term
    simile: tuple[str, ...]
    numerals: tuple[str, ...]
    listed: tuple[str, ...]  # texts whose purpose is to define
    false_markers: tuple[str, ...]
    demonstratives: tuple[str, ...]
    closing: str  # beginning of the word between demonstrative and term
    designation: str  # beginning of the word that lets a genitive pass
    opening: str  # beginnings of the words that open and close a comparison
    answer: str
    stem_endings: tuple[str, ...]  # of terms in -a, behind the stem
    other_endings: tuple[str, ...]  # of others, behind the term
    oblique_stem: tuple[str, ...]
    oblique_other: tuple[str, ...]
    genitive_stem: tuple[str, ...]
    genitive_other: tuple[str, ...]
    strata: tuple[tuple[str, int], ...]
    family: str
    family_stratum: int = 2
    other_stratum: int = 3
    penalties: tuple[int, ...] = (0, -2, -4, -8)
    proximity: int = 14
    closer_window: int = 2
    closer_bonus: int = 6


CANON = DefinitionRules(
    interrogative=("katam", "katham", "vadeth"),
    question_word="kattha",
    question_pair="datthabb",
    predicate=("vucc", "adhivacan", "yadidam"),
    named="nama",
    simile=("seyyathapi", "upam", "opam", "opamm", "evameva"),
    numerals=tuple("dve dvi tayo tini cattaro cattari panca cha satta attha nava dasa seyyathidam".split()),
    listed=tuple(
        "mn135 mn136 mn137 mn138 mn139 mn140 mn141 mn142 sn12.2 sn22.79 sn45.8 sn47.40 sn48.9 sn48.10 sn48.36 "
        "sn48.37 sn48.38 sn51.20 dn15 dn22 dn33 dn34 an3.34 an3.111 an3.112 an6.39 an10.174 sn12.60 sn14.12".split()
    ),
    false_markers=("katam",),
    demonstratives=tuple("ayam ayan idam ime ima imani eso esa etam ete etani".split()),
    closing="vucc",
    designation="adhivacan",
    opening="seyyathapi",
    answer="evameva",
    stem_endings=tuple("a o am ena assa aya amhi asmim e ani ehi ebhi anam esu ato asma an anti".split()),
    other_endings=("", *"m ssa ya no ni na smim su nam".split()),
    oblique_stem=tuple("e amhi asmim esu ena ehi ebhi ato asma".split()),
    oblique_other=("smim", "su"),
    genitive_stem=("assa", "anam", "aya"),
    genitive_other=("ssa", "nam", "no", "ya"),
    strata=tuple((b, 0) for b in ("dn", "mn", "sn", "an")) + tuple((b, 1) for b in ("dhp", "ud", "iti", "snp", "thag", "thig")),
    family="pli-tv",
)

#: For the invented prose of the test tables.
PROSE = DefinitionRules(
    interrogative=("wh", "wer"),
    question_word="this",
    question_pair="with",
    predicate=("from", "von", "par"),
    named="are",
    simile=("as", "mit", "sur"),
    numerals=("in", "und", "un"),
    listed=("en3", "en6"),
    false_markers=("who",),
    demonstratives=("it", "das", "la"),
    closing="is",
    designation="that",
    opening="for",
    answer="on",
    stem_endings=("a", "e", "o"),
    other_endings=("", "s", "r", "n"),
    oblique_stem=("e",),
    oblique_other=("n",),
    genitive_stem=("o",),
    genitive_other=("r",),
    strata=(("en", 0), ("de", 1)),
    family="fr",
)

#: Suffix, vowel of the stem, case; for dictionary words that keep their marks.
LEMMA_RULES = (
    ("ānaṃ", "a", "gen./dat. pl."),
    ("āsu", "ā", "loc. pl. (f.)"),
    ("assa", "a", "gen./dat. sg."),
    ("āhi", "ā", "inst./abl. pl. (f.)"),
    ("āya", "ā", "dat./gen. sg. (f.)"),
    ("āyaṃ", "ā", "loc. sg. (f.)"),
    ("āyo", "ā", "nom./acc. pl. (f.)"),
    ("ehi", "a", "inst./abl. pl."),
    ("esu", "a", "loc. pl."),
    ("ena", "a", "inst. sg."),
    ("iyā", "i", "inst./gen. sg. (f.)"),
    ("iyo", "i", "nom./acc. pl. (f.)"),
    ("īhi", "ī", "inst./abl. pl. (f.)"),
    ("īnaṃ", "ī", "gen./dat. pl. (f.)"),
    ("īsu", "ī", "loc. pl. (f.)"),
    ("aṃ", "a", "acc. sg."),
    ("ā", "a", "nom. pl. / inst. sg."),
    ("e", "a", "loc. sg. / nom. pl."),
    ("o", "a", "nom. sg."),
)
PROSE_LEMMAS = (("ung", "en", "noun"), ("es", "e", "plural"), ("s", "", "plural"), ("en", "", "plural"), ("ed", "", "past"), ("e", "", "other"))

#: Suffix and the endings that may stand in its place.
STEM_RULES = (
    ("ānaṁ", ("a", "ā", "i", "ī", "u", "ū")),
    ("naṁ", ("a", "ā", "i", "ī", "u", "ū")),
    ("āya", ("a", "ā")),
    ("assa", ("a",)),
    ("ssa", ("a", "i", "u")),
    ("smā", ("a",)),
    ("mhā", ("a",)),
    ("smiṁ", ("a",)),
    ("mhi", ("a",)),
    ("ena", ("a",)),
    ("ebhi", ("a",)),
    ("ehi", ("a",)),
    ("esu", ("a", "i", "u")),
    ("su", ("a", "ā", "i", "ī", "u", "ū")),
    ("aṁ", ("a", "ā")),
    ("ṁ", ("a", "i", "u")),
    ("āni", ("a",)),
    ("ni", ("i", "u")),
    ("e", ("a",)),
    ("ā", ("a",)),
    ("o", ("a", "u")),
)
SHORTENED = (("īnaṁ", "i"), ("ūnaṁ", "u"))

EARLY = ("dhp", "ud", "iti", "snp")
LESSER = (*EARLY, *"mil ne pe mnd cnd ps kp vv pv thag thig tha-ap thi-ap bv cp ja".split())
SCHOLASTIC = ("ds", "vb", "dt", "pp", "kv", "ya", "patthana")
MAIN = ("dn", "mn", "sn", "an")
PRESETS = {"ebt": (*MAIN, *EARLY), "sutta": (*MAIN, *LESSER), "vinaya": ("pli-tv",), "abhidhamma": SCHOLASTIC}
KNOWN_BOOKS = frozenset((*PRESETS["sutta"], *SCHOLASTIC, "pli-tv"))

#: Files of the top folder that belong to a collection.
TOP_FILES = (("pli-tv-bu-pm", "pli-tv-bu-vb"), ("pli-tv-bi-pm", "pli-tv-bi-vb"))

BOOK_NAMES = {
    "dn": "Dīgha Nikāya",
    "mn": "Majjhima Nikāya",
    "sn": "Saṁyutta Nikāya",
    "an": "Aṅguttara Nikāya",
    "kp": "Khuddakapāṭha",
    "dhp": "Dhammapada",
    "ud": "Udāna",
    "iti": "Itivuttaka",
    "snp": "Sutta Nipāta",
    "vv": "Vimānavatthu",
    "pv": "Petavatthu",
    "thag": "Theragāthā",
    "thig": "Therīgāthā",
    "tha-ap": "Therāpadāna",
    "thi-ap": "Therīapādāna",
    "bv": "Buddhavaṁsa",
    "cp": "Cariyāpiṭaka",
    "ja": "Jātaka",
    "ne": "Nettippakaraṇa",
    "pe": "Peṭakopadesa",
    "mil": "Milindapañha",
    "ds": "Dhammasaṅgaṇī",
    "vb": "Vibhaṅga",
    "dt": "Dhātukathā",
    "pp": "Puggalapaññatti",
    "kv": "Kathāvatthu",
    "ya": "Yamaka",
    "patthana": "Paṭṭhāna",
}
NUMBER_NAMES = {
    **dict.fromkeys(("dhp", "thag", "thig", "ud", "iti", "vv", "pv"), "verse"),
    "snp": "sutta",
    "kp": "passage",
    "bv": "section",
    "cp": "section",
    "ja": "story",
    **dict.fromkeys(SCHOLASTIC, "ch."),
}
DOTTED_NAMES = {
    "sn": ("saṁyutta", "sutta"),
    "an": ("nipāta", "sutta"),
    **dict.fromkeys(("snp", "ud", "iti"), ("vagga", "sutta")),
    **dict.fromkeys(("thag", "thig"), ("nipāta", "verse")),
    "ja": ("nipāta", "story"),
    "mil": ("vagga", "section"),
    "kv": ("kathā", "subsection"),
    **dict.fromkeys(("ds", "dt", "ya", "patthana", "pp"), ("section", "subsection")),
}
PART_NAMES = {
    "pli": "Pāli",
    "tv": "Theravāda",
    "bu": "Bhikkhu",
    "bi": "Bhikkhunī",
    "vb": "Vibhaṅga",
    "kd": "Khandhaka",
    "pvr": "Parivāra",
    "pm": "Pātimokkha",
    "pj": "Pārājika",
    "ss": "Saṅghādisesa",
    "ay": "Aniyata",
    "np": "Nissaggiya Pācittiya",
    "pc": "Pācittiya",
    "pd": "Pāṭidesanīya",
    "sk": "Sekhiya",
    "as": "Adhikaraṇasamatha",
}
