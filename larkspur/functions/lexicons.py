"""Word lists and patterns that results depend on."""

# Fixed values. Words that search boosts leave out.
BOOST_STOP = (
    "what when where who how which did do was were have has had is are the a an my me i you your their it its in on at to for of with by from "
    "ago last that this there about get got give gave buy bought made make can could would should will shall may might been"
).split()

# Fixed values. Words that memory queries leave out.
MEMORY_STOP = (
    "what when where who how which why is am are was were be been being do did does done have has had will would could should can may might shall "
    "i me my you your he him his she her it its we us our they them their these those this that in on at to for of with by from into over after before "
    "between through during above below up down out off under the a an and or but nor so as if while although though until unless because go going went "
    "gone get got getting give gave buy bought made make like likely not no very just also too than some any all each every both few more most other such "
    "only same again further then once here there about still already yet even much many ago last long"
).split()

# Fixed values. Words that intents leave out.
INTENT_STOP = (
    "am an as at be by do he if in is it me my no of on or so to up us we all and any are but can did for get has her him his how its let may not our out "
    "the too was who why you also does find from have into more need show some tell that them this want what when will with your about looking notes search where which"
).split()

# Fixed values. Capitalised words that are no proper nouns, and heads that start no entity.
DENSITY_STOP = "the that this these those there then than what when where which who whom whose why how if unless although while since because yes no maybe okay ok".split()
ENTITY_STOP = "Which Who What When Where How Why Did Does Is Are Was Were The This That These Those Yes No".split()

# Fixed values. Category patterns in order of precedence; (?i) marks those that ignore case.
CATEGORY_PATTERNS = {
    "preference": [
        r"(?i)\bi (?:usually |always )?prefer\b",
        r"(?i)\bi (?:always |usually )(?:use|do|go with)\b",
        r"(?i)\bi don'?t (?:like|want|use)\b",
        r"(?i)\bi (?:love|hate|enjoy|avoid)\b",
        r"(?i)\bmy (?:favorite|preferred|go-to)\b",
        r"(?i)\bi (?:tend to|lean toward)\b",
        r"(?i)\bi(?:'m| am) (?:a fan of|not a fan of)\b",
        r"(?i)\bi still remember\b",
        r"(?i)\bi used to\b",
        r"(?i)\bwhen i was\b",
        r"(?i)\bgrowing up\b",
        r"(?i)\bi've been having (?:trouble|issues?|problems?) with\b",
        r"(?i)\bi've been feeling\b",
        r"(?i)\bi(?:'m| am) (?:worried|concerned) about\b",
        r"(?i)\bi want to\b",
        r"(?i)\bi'm thinking (?:about|of)\b",
    ],
    "decision": [
        r"(?i)\bwe (?:decided|went with|chose|picked)\b",
        r"(?i)\blet'?s (?:use|go with|try|pick|switch to)\b",
        r"(?i)\bthe decision (?:is|was)\b",
        r"(?i)\bwe(?:'re| are) going (?:to|with)\b",
        r"(?i)\bi'?ve decided\b",
        r"(?i)\bafter (?:consideration|discussion|review)\b",
    ],
    "fact": [
        r"(?i)\b(?:actually|turns out|apparently)\b",
        r"(?i)\b(?:it is|it's|that's) (?:a |the )?(?:fact|truth|case)\b",
        r"(?i)\b(?:works at|lives in|born in|graduated from)\b",
        r"(?i)\b(?:the (?:answer|solution|reason|cause) (?:is|was))\b",
        r"(?i)\b(?:as of|since|starting from)\b",
    ],
    "entity": [
        r"\b[A-Z][a-z]+ (?:is|was|works at|lives in)\b",
        r"\b[A-Z][a-z]+ (?:said|asked|mentioned|told me)\b",
        r"(?i)\b(?:the|our) (?:team|project|company|server|service) (?:is |was |called )",
    ],
    "reflection": [
        r"(?i)\bi (?:realized|noticed|learned|discovered)\b",
        r"(?i)\bin hindsight\b",
        r"(?i)\blooking back\b",
        r"(?i)\bthe (?:lesson|takeaway|insight) (?:is|was)\b",
        r"(?i)\bi should(?:'ve| have)\b",
        r"(?i)\bnext time\b",
    ],
}
# Fixed values. What a preference goes on with.
BRIDGE_PATTERNS = [
    r"(?i)\bi (?:usually |always )?prefer ([^\n]{5,80})",
    r"(?i)\bi (?:always |usually )(?:use|do|go with) ([^\n]{5,80})",
    r"(?i)\bi don'?t (?:like|want|use) ([^\n]{5,80})",
    r"(?i)\bi (?:love|hate|enjoy|avoid) ([^\n]{5,80})",
    r"(?i)\bmy (?:favorite|preferred|go-to) (?:is |are )?([^\n]{5,80})",
    r"(?i)\bi (?:tend to|lean toward) ([^\n]{5,80})",
    r"(?i)\bi've been having (?:trouble|issues?|problems?) with ([^\n]{5,60})",
    r"(?i)\bi(?:'m| am) (?:worried|concerned) about ([^\n]{5,60})",
    r"(?i)\bi want to ([^\n]{5,60})",
    r"(?i)\bi'm thinking (?:about|of) ([^\n]{5,60})",
]
# Fixed values. Words of commitment.
COMMITMENT_PATTERNS = [
    r"(?i)\b(?:decided|decide|chose|choose|picked|going to|will|plan(?:ned|ning)? to)\b",
    r"(?i)\b(?:committed to|agreed to|settled on|opted for)\b",
]
# Fixed values. Importance of a category before bonuses (others 0.5).
CATEGORY_IMPORTANCE = {"decision": 0.8, "fact": 0.7, "entity": 0.7, "preference": 0.6, "reflection": 0.6}
# Fixed values. (pattern with the number or none, days a unit, window in days), first match wins.
TIME_PATTERNS = [
    (r"(\d+)\s*days?\s*ago", 1, 3),
    (r"a couple of days ago", 2, 2),
    (r"(\d+)\s*weeks?\s*ago", 7, 7),
    (r"a week ago|last week", 7, 7),
    (r"(\d+)\s*months?\s*ago", 30, 14),
    (r"a month ago|last month", 30, 14),
    (r"yesterday", 1, 1),
    (r"recently|the other day", 3, 7),
]
