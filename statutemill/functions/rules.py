"""Patterns, word lists and sizes of the legal texts. Patterns are Java regular expressions.

A rules object (Rules) carries what differs between document types; callers pass their own for other corpora.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Legal abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("jf.", "bl.a.", "f.eks.", "pkt.", "nr.", "stk.", "ca.", "evt.", "osv.", "mv.", "inkl.", "ekskl.", "hhv.", "vedr.", "afd.", "div.", "pga.", "SKM.", "TfS.", "RR.")
ABBREVIATIONS_GUIDANCE = ABBREVIATIONS[:17]

# Person groups and the words that name them.
PERSON_GROUPS = {
    "grænsegænger": ("grænsegænger", "pendler over grænsen"),
    "udsendt medarbejder": ("udsendt medarbejder", "udstationeret"),
    "søfolk": ("søfolk", "søfarende", "skibspersonale"),
    "selvstændige": ("selvstændige", "selvstændig erhvervsdrivende"),
    "ansatte i det offentlige": ("offentligt ansat", "tjenestemænd", "offentlig myndighed"),
    "forskere og nøglemedarbejdere": ("forsker", "nøglemedarbejder", "forskerskatteordning"),
    "kunstnere og sportsudøvere": ("kunstner", "sportsudøver", "atlet"),
    "pensionister": ("pensionist", "pension", "efterløn"),
    "studerende": ("studerende", "elev", "lærling"),
}

# Wording of exceptions, each up to the end of its clause (group 1).
EXCEPTIONS = (
    r"(?iu)((?:undtagelse|særregel|specialregel)[^.;,]*)(?:[.;]|$)",
    r"(?iu)((?:gælder ikke|finder ikke anvendelse)[^.;,]*)(?:[.;]|$)",
    r"(?iu)((?:medmindre|dog ikke|undtaget herfra er)[^.;,]*)(?:[.;]|$)",
    r"(?iu)((?:uanset|til trods for)[^.;,]*)(?:[.;]|$)",
    r"(?iu)((?:Hovedreglen|Udgangspunktet).*?(?:men|dog)[^.;,]*)(?:[.;]|$)",
)
# Named special rules, by pattern.
NAMED_EXCEPTIONS = (
    (r"(?iu)\bgrænse(?:gænger|pendler)", ("Grænsegængerreglerne", "grænsegænger")),
    (r"(?iu)§§?\s*5\s*[A-D]", ("KSL §§ 5 A-D",)),
    (r"(?iu)\b42[\s-]*dages?\b", ("42-dages reglen",)),
    (r"(?iu)\bseks\s+m[åa]neder\b|\b6\s+m[åa]neder\b", ("6-måneders reglen",)),
)

# Words of questions.
QUESTION_THEMES = ("dobbeltbeskatning", "lempelse", "skattefritagelse", "skattepligt", "udlandsophold", "grænsegænger", "systemeksport", "offentligt ansat", "søfolk")
QUESTION_GROUPS = ("grænsegænger", "offentligt ansat", "søfolk", "udsendt", "selvstændig")
QUESTION_SPECIAL_RULES = ("undtagelse", "særregel", "halv lempelse", "fuldt skattepligtig")

# References that hang in the air without what came before.
DANGLING = (
    r"(?U)\b(som nævnt|ovenfor nævnte|denne|disse)\b",
    r"(?U)\b(det|dette|sådan[nt]?)\s+(?!er|har|kan|vil|må)",
    r"(?U)\b(den|de)\s+(?:omtalt|nævnt)",
    r"(?U)\b(derfor|således|herefter|følgelig)\b",
)

# Type of a chunk by its first words, in order.
CHUNK_TYPES = (
    ("regel", r"(?U)^\s*(?:hovedregel|regel)\b"),
    ("note", r"(?U)^\s*bemærk\b"),
    ("reference", r"(?U)^\s*(?:se også|der henvises til)\b"),
    ("undtagelse", r"(?U)^\s*(?:undtagelse|særregel)\b"),
    ("eksempel", r"(?U)^\s*(?:eksempel|for eksempel|til illustration)\b"),
    ("definition", r"(?U)^\s*(?:definition|defineres som|forstås ved)\b"),
)
# Size of a chunk type, relative to the target.
TYPE_SIZES = {"eksempel": 0.7, "oversigt": 1.5, "reference": 0.5, "note": 0.6, "regel": 1.3, "definition": 0.8, "undtagelse": 1.2}
COMPLEX_TERMS = ("dog", "medmindre", "såfremt", "forudsat", "betinget af", "undtagelsesvis")

# Patterns that tell document types apart, and those of their subtypes.
DOCUMENT_TYPES = {
    "lovtekst": ((r"§\s*\d+", r"stk\.\s*\d+"), {"ligningsloven": (r"ligningslovens?", r"ligningslov", r"§\s*33\s*a"), "personskatteloven": (r"personskattelovens?", r"personskattelov"), "kildeskatteloven": (r"kildeskattelovens?", r"kildeskattelov", r"skattepligtig")}),
    "vejledning": ((r"\d+\.\d+\.\d+\s+[a-z]", r"juridiske?\s+vejledning", r"vejledende", r"eksempel:"), {"den_juridiske_vejledning": (r"juridiske?\s+vejledning", r"[a-z]\.\d+\.\d+"), "styresignal": (r"styresignal", r"skatte\s*styrelsens?")}),
    "cirkulaere": ((r"cirkulære\s+nr\.\s+\d+", r"cir\.\s+nr\.\s+\d+", r"\d+\.\s+[a-z][^\n]*\n\d+\.\d+\.\s+[a-z]"), {}),
    "afgoerelse": ((r"(?:skm|tfs|lsr)[.\s]*\d{4}[.\s]*\d+", r"kendelse", r"afsagt\s+den", r"retten\s+i"), {}),
}

# Phrases that a note of this number must hold.
NOTE_PHRASES = {"795": ("grænsegængere", "kildeskattelovens §§ 5 A-5 D")}

# Marks of paragraphs that open something new, by strength.
STRONG_BREAKS = (r"^\s*Hovedregel\b", r"^\s*Regel\b", r"^\s*Undtagelse(n|rne)?\b", r"^\s*Eksempel\b", r"^\s*Definition\b")
MEDIUM_BREAKS = (r"^\s*Se også\b", r"^\s*Der henvises til\b", r"^\s*I praksis\b", r"^\s*Forudsætninger(ne)?\b", r"^\s*Betingelser(ne)?\b")
WEAK_BREAKS = (r"Det (antages|forudsættes|kræves)\b", r"Det (bemærkes|fremgår|følger)\b", r"Dette gælder (også|dog|ikke)\b", r"Følgende (betingelser|krav|forudsætninger)")

# How examples are introduced, and examples without an introduction.
EXAMPLE_WORDING = (
    r"(Eksempel\s+\d+\s*[:.][^E]*?)(?=Eksempel\s+\d+|$)",
    r"(Eksempel\s*[:.][^E]*?)(?=Eksempel|$)",
    r"(Følgende\s+eksempel[^.]*?illustrerer.*?(?:\n\n|$))",
    r"((?:Til\s+illustration|Som\s+eksempel)[^.]*?(?:kan\s+nævnes|vises).*?(?:\n\n|$))",
    r"(For\s+eksempel\s+(?:kan|vil|har).*?(?:\n\n|$))",
)
IMPLICIT_EXAMPLE = r"(?<!\w)((?:Hvis|Lad os antag|Tænk på)[^.]*?(?:person|firma|virksomhed|selskab)[^.]*?(?:der|som|hvilket)[^.]*?(?:\n\n|$))"
# How rules begin, in order of preference; each up to a blank line.
RULE_WORDING = (r"((?:Hovedregel|Regel).*?)(?=\n\n)", r"((?:Reglerne|Reglen).*?)(?=\n\n)", r"((?:Efter|Ifølge).*?(?:gælder|er).*?)(?=\n\n)")
# How overviews of cases begin.
CASE_TABLE_WORDING = (r"((?:Skemaet|Oversigten)\s+viser.*?)(?=\n\n|$)", r"((?:Følgende|Nedenstående)\s+(?:afgørelser|domme|kendelser).*?)(?=\n\n|$)", r"((?:Domsoversigt|Afgørelsesoversigt).*?)(?=\n\n|$)")
CASE_TABLE_SUBSECTION = "Oversigt over domme, kendelser, afgørelser mv."

SECTION_ID = r"[A-Z]\.[A-Z]\.\d+\.\d+\.\d+"
PARAGRAPH = r"\d+(?:\s*[A-Z](?![A-Za-zæøåÆØÅ]))?"

# Sizes in characters.
MAX_SEGMENT, SPLIT_ABOVE, TARGET, MIN_CHUNK = 30_000, 15_000, 1000, 250
TOO_SMALL, TOO_LARGE = 200, 2000


@dataclass(frozen=True)
class Rules:
    """What a document type needs: how it is cleaned and segmented, and its lexicons."""

    cleaner: str
    segmenter: str
    law_abbreviations: dict[str, str] = field(default_factory=dict)
    person_groups: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PERSON_GROUPS))
    question_patterns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"general": ("hvornår", "hvordan", "hvilke regler")})
    exceptions: tuple[str, ...] = ()
    concepts: tuple[str, ...] = ()
    default_law: str | None = None
    default_theme: str = "skatteret"


LAW_ABBREVIATIONS = {"ligningslov": "LL", "kildeskattelov": "KSL", "personskattelov": "PSL", "statsskattelov": "SL", "selskabsskattelov": "SEL", "skattekontrollov": "SKL"}
RULES = {
    "lovtekst": Rules("law", "paragraphs", LAW_ABBREVIATIONS),
    "afgoerelse": Rules("law", "paragraphs", LAW_ABBREVIATIONS),
    "generisk": Rules("law", "paragraphs", LAW_ABBREVIATIONS),
    "vejledning": Rules("guidance", "guidance_main", LAW_ABBREVIATIONS),
    "cirkulaere": Rules("circular", "circular", LAW_ABBREVIATIONS),
    "den_juridiske_vejledning": Rules("legal_guidance", "sections", LAW_ABBREVIATIONS),
}
