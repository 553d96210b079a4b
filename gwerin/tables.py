"""Rule tables of initial-consonant change. Fixed values, kept as data so that callers can pass their own."""

SOFT = {"p": "b", "t": "d", "c": "g", "b": "f", "d": "dd", "g": "", "ll": "l", "rh": "r", "m": "f"}
SOFT_LIMITED = {k: v for k, v in SOFT.items() if k not in ("ll", "rh")}
NASAL = {"p": "mh", "t": "nh", "c": "ngh", "b": "m", "d": "n", "g": "ng"}
ASPIRATE = {"p": "ph", "t": "th", "c": "ch"}
AFFRICATE = {"ts": "j"}
FORWARD = {"soft": SOFT, "soft_limited": SOFT_LIMITED, "nasal": NASAL, "aspirate": ASPIRATE, "colloquial_affricate": AFFRICATE}
SURFACE_TYPE = {"b": "soft", "d": "soft", "g": "soft", "f": "soft", "dd": "soft", "l": "soft", "r": "soft", "": "soft", "mh": "nasal", "nh": "nasal", "ngh": "nasal", "m": "nasal", "n": "nasal", "ng": "nasal", "ph": "aspirate", "th": "aspirate", "ch": "aspirate", "j": "colloquial_affricate"}
CLUSTERS = ["ngh", "mh", "nh", "dd", "ff", "ll", "ph", "rh", "th", "ch", "ng", "ts", "j"]
INVARIANT = {"nasal": ["ch", "f", "h", "j", "ll", "m", "n", "rh", "s"], "aspirate": ["b", "d", "f", "g", "h", "j", "ll", "m", "n", "rh", "s"], "soft": ["ch", "f", "h", "j", "n", "s"], "soft_limited": ["ch", "f", "h", "j", "n", "s"]}
TAG_TYPES = {"TM": "soft", "TT": "nasal", "TL": "aspirate", "TH": "h-mutation"}
PARSER_TYPES = {"SM": "soft", "NM": "nasal", "AM": "aspirate"}
TRIGGERS = {
    "am": "soft", "ar": "soft", "at": "soft", "dan": "soft", "dros": "soft", "drwy": "soft", "heb": "soft", "wrth": "soft", "gan": "soft", "i": "soft", "o": "soft", "hyd": "soft", "tua": "aspirate", "thua": "aspirate", "neu": "soft", "pan": "soft", "ail": "soft",
    "ni": "soft|aspirate", "nid": "soft|aspirate", "na": "soft|aspirate", "oni": "soft|aspirate", "beth": "soft", "pa": "soft", "pwy": "soft", "sut": "soft", "rhy": "soft", "lled": "soft", "pur": "soft_limited", "reit": "soft", "hollol": "soft", "gweddol": "soft", "go": "soft", "llwyr": "soft",
    "hen": "soft", "rhyw": "soft", "ychydig": "soft", "amryw": "soft", "prif": "soft", "mor": "soft_limited", "cyn": "soft_limited", "mae": "soft", "ydy": "soft", "oes": "soft", "sy": "soft", "sydd": "soft", "dyma": "soft", "dyna": "soft", "yna": "soft", "mai": "soft", "taw": "soft", "pe": "soft",
    "fy": "nasal", "dy": "soft", "ei": "soft|aspirate", "ein": "h-mutation", "eu": "h-mutation", "u": "h-mutation", "tri": "aspirate", "chwe": "aspirate", "a": "soft|aspirate", "â": "aspirate", "gyda": "aspirate", "tra": "aspirate", "yn": "nasal|soft_limited", "ym": "nasal", "yng": "nasal", "yr": "soft_limited", "fe": "soft", "mi": "soft", "dau": "soft", "dwy": "soft",
}
MIXED = ["na", "ni", "nid", "oni"]
FILLERS = ["ah", "chdi", "er", "ffeil", "gwybod", "iawn", "te", "ym"]
VOWELS = "aeiouwyâêîôûŵŷ"
ENGLISH_FUNCTION_WORDS = "about after an and are as at be because been before being but by can can't could couldn't did didn't do does doesn't don't for from get got had has have he her here his how i'm if into is it it's its just my not of or over people she should shouldn't than that that's the their them then there these they they're thing things this those to was we're were what when where who why will with won't would wouldn't yes you you're your".split()
HOMOGRAPHS = ["a", "am", "i", "in", "mi", "no", "un"]
BOD_FORMS = "bo bod boed bu buasai buasech buasem buasent buaset buaswn bues buoch buodd buom buon buost bydd byddaf byddai byddan byddech byddem byddent byddi byddo byddwch byddwn dan dw dwi dyn fod foed fu fuasai fuasech fuasem fuasent fuaset fuaswn fues fuoch fuodd fuom fuon fuost fydd fyddai fyddan fyddem fyddent fyddi fyddwch fyddwn mae maen maent oedd oeddech oeddem oedden oeddet oeddwn oes on oni roedd roeddech roeddem roedden roeddet roeddwn sa san se sen set sy sydd wyf wyt ydy ydych ydym ydyn ydyw yw".split()
CONTRACTIONS = {"i'r": ["i", "'r"], "a'r": ["a", "'r"], "o'r": ["o", "'r"], "i'w": ["i", "'w"], "a'i": ["a", "'i"], "o'i": ["o", "'i"]}
SUPPLETIVE = ["gorau", "gwaeth", "gwaethaf", "gwell", "llai", "lleiaf", "mwy", "mwyaf", "nes", "nesaf"]
EVALUABLE = ["correct_mutation", "erosion", "mutation_mismatch", "wrong_mutation_type"]
IMPOSSIBLE_PAIRS = "aa bh dh fh gh ii qa qe qi qo qu qw qy sh uu xb xd xf xg xl xm xn xp xr xs xt xw".split()
SINGLE_CLUSTERS = "ch ff ll mh ngh ng nh ph rh th".split()
# letters of the language that carry a mark
LEGAL_MARKED = "âêîôûŵŷáéíóúàèìòùïë"
NULLS = ["", "n/a", "NA", "None", "nan", "null", "N/A", "NULL", "NaN", "#N/A", "<NA>"]
AGREEING = ["all_three", "cysill+heuristic", "parser+heuristic"]
STATUS_LABELS = {"correct_mutation": "Correct", "selective_invariancy": "Selective Mutation (correct)", "erosion": "Erosion (radical)", "wrong_mutation_type": "Erosion (wrong type)", "mutation_mismatch": "Mismatch", "phantom_mutation": "Phantom", "code_switch": "Code-Switch", "mutation_absent_expected_none": "No mutation required", "colloquial_variant": "Colloquial Variant"}
ARTICLES = ["r", "y", "yr"]
LL_RH_EXEMPT = ["cyn", "mor", "pur", "yn"]
LL_RH_EXEMPT_NOUNS = ["r", "un", "y", "yr"]
BOD_TRIGGERS = ["mae", "oes", "ydy"]
H_TRIGGERS = ["ein", "eu", "u"]
NASAL_NUMERALS = ["100", "12", "15", "18", "20", "cant", "deng", "deuddeg", "deunaw", "naw", "pump", "pymtheg", "saith", "ugain", "wyth"]
NASAL_NUMERAL_TARGETS = ["blwydd", "blynedd", "diwrnod"]
PREPOSED_ADJECTIVES = ["ambell", "aml", "amryw", "annwyl", "gau", "hen", "holl", "rhyw", "unig", "unrhyw", "ychydig"]
COMPOUND_SECOND = {"craig": "gardd", "haf": "dydd", "bar": "morwyn", "hwyl": "pren", "rhwyd": "gwaith", "modur": "tŷ"}
OBJ_DEPS = ["iobj", "obj"]
VOCATIVE_DEPS = ["vocative"]
PHANTOM_TAGS = ["NF", "NM", "VBF", "VB", "VB+NM", "NM+VBF", "PLACE", "PERSON"]
# letters and the combining marks that they are composed with
MARKED = {"\u0300": "aàeèiìoòuù", "\u0301": "aáeéiíoóuú", "\u0302": "aâeêiîoôuûwŵyŷ", "\u0308": "aäeëiïoöuü", "\u0303": "aãnñoõ", "\u0327": "cç", "\u030a": "aå"}
LEXICON_TYPES = {"SM": "soft", "NM": "nasal", "AM": "aspirate", "HM": "h-mutation"}
LEXICON_GENDERS = {"Masc": "masculine", "Fem": "feminine"}
LEXICON_NUMBERS = {"Sing": "singular", "Plur": "plural"}
COLLISIONS = {"chi": "Pronoun 'chi' (you) collides with aspirate-mutated 'ci' (dog -> chi)."}
