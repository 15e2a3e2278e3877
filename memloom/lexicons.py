"""Word lists and label tables that fix results. Fixed values, in their natural order."""

# What counts as a token.
TOKEN_RE = r"[A-Za-z][A-Za-z0-9_-]{1,}"

# Words that are neither entities nor topics.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being but by can could did do does doing for from get got "
    "had has have how i if in into is it its just like me more most my no not of on or our so that the their them then there these "
    "they this to up use using was we were what when which who why with would you your"
).split()

# Emotion keyword -> code, first match first.
EMOTIONS = (
    ("decided", "determ"), ("prefer", "convict"), ("worried", "anx"), ("excited", "excite"), ("frustrated", "frust"),
    ("confused", "confuse"), ("love", "love"), ("hate", "rage"), ("hope", "hope"), ("fear", "fear"), ("trust", "trust"),
    ("happy", "joy"), ("sad", "grief"), ("surprised", "surprise"), ("grateful", "grat"), ("curious", "curious"),
    ("wonder", "wonder"), ("anxious", "anx"), ("relieved", "relief"), ("concern", "anx"),
)

# Flag keyword -> flag.
FLAGS = (
    ("decided", "DECISION"), ("chose", "DECISION"), ("switched", "DECISION"), ("migrated", "DECISION"), ("replaced", "DECISION"),
    ("instead of", "DECISION"), ("because", "DECISION"), ("founded", "ORIGIN"), ("created", "ORIGIN"), ("started", "ORIGIN"),
    ("born", "ORIGIN"), ("launched", "ORIGIN"), ("core", "CORE"), ("fundamental", "CORE"), ("essential", "CORE"),
    ("principle", "CORE"), ("sensitive", "SENSITIVE"), ("private", "SENSITIVE"), ("confidential", "SENSITIVE"),
    ("turning point", "PIVOT"), ("pivot", "PIVOT"), ("changed everything", "PIVOT"), ("breakthrough", "PIVOT"), ("genesis", "GENESIS"),
)

# Words that mark a key sentence.
DECISION_WORDS = (
    "decided because instead prefer switched chose realized important key critical discovered learned solution reason why breakthrough insight"
).split()

# Causal and turn markers -> label.
CAUSAL_MARKERS = (
    ("because", "cause"), ("since", "cause"), ("therefore", "effect"), ("thus", "effect"), ("hence", "effect"), ("so", "effect"),
    ("result", "effect"), ("caused", "cause"), ("causes", "cause"), ("led", "effect"), ("due", "cause"), ("if", "condition"), ("unless", "condition"),
)
TURN_MARKERS = (
    ("but", "contrast"), ("however", "contrast"), ("although", "contrast"), ("though", "contrast"), ("instead", "redirect"),
    ("rather", "redirect"), ("yet", "contrast"), ("then", "progression"), ("finally", "resolution"), ("eventually", "resolution"),
    ("meanwhile", "parallel"), ("before", "setup"), ("after", "aftermath"), ("suddenly", "surprise"), ("?", "inquiry"),
)

# Scene words, the first list that fits decides.
SCENE_MODES = (
    (("repair", "track", "inventory", "record", "list"), "inventory_management"),
    (("decide", "choose", "switch", "because"), "decision_making"),
)
SCENE_TONES = (
    (("worried", "concern", "uncertain", "not sure"), "cautious", 0.7),
    (("amazing", "excited", "interesting", "wow"), "enthusiastic", 0.2),
    (("need", "must", "should", "track"), "practical", 0.25),
)

# Scenes of the item builder, (words, tone, mode, uncertainty).
RECALL_SCENES = (
    (("need", "schedule", "track", "list", "record"), "practical", "practical_planning", 0.25),
    (("why", "because", "reason", "caused"), "analytic", "causal_reflection", 0.3),
    (("wow", "amazing", "interesting", "excited"), "enthusiastic", "enthusiastic_discussion", 0.2),
)

# Question words that decide the task type, in this order.
TASK_RULES = (
    (("why", "reason", "because", "caused"), "causal_recall"),
    (("when", "first time", "changed", "switch", "turning point"), "turning_point_recall"),
    (("allow", "allowed", "forbidden", "blocked", "next step", "preference"), "constraint_recall"),
    (
        ("remember", "which one", "what item", "what did i", "where did i", "what degree", "what play", "what is the name", "which social media platform"),
        "cue_recall",
    ),
)
PREFERENCE_TYPE = "single-session-preference"

# Words that let a turn into a causal chain.
CHAIN_WORDS = ("because", "caused", "reason", "why")

#: A small lexicon of words that are frequent in invented prose, so that every branch of a lexicon query is taken.
TEST_EMOTIONS = (("hate", "rage"), ("sad", "grief"), ("the", "calm"), ("and", "joy"), ("ing", "hope"), ("que", "love"))
TEST_FLAGS = (("tion", "DECISION"), ("ment", "PIVOT"), ("lich", "ORIGIN"), ("ción", "CORE"), ("so", "CORE"))
TEST_CAUSAL = (("tion", "cause"), ("so", "effect"), ("if", "condition"))
TEST_TURNS = (("then", "progression"), ("but", "contrast"), ("ou", "redirect"), ("?", "inquiry"))

# Verbs that are relations by themselves, and endings that make one.
COMMON_VERBS = (
    "adopt build buy change choose compare debug decide deploy discuss explain fix implement improve learn migrate plan prefer refactor "
    "remember replace research review ship switch test travel update use want work"
).split()
VERB_ENDINGS = ("ed", "ing", "ize", "ise")

# Flag -> relation.
FLAG_RELATIONS = (
    ("DECISION", "decision"), ("ORIGIN", "origin"), ("CORE", "principle"), ("PIVOT", "transition"), ("SENSITIVE", "private"), ("GENESIS", "origin"),
)

# Tone -> shift of the phase.
TONE_SHIFTS = (("contrastive", 0.65), ("assertive", 0.45), ("uncertain", -0.35), ("reflective", 0.20), ("tense", 0.55), ("positive", 0.25))

# Words of a state that give it a tone, in this order.
TONE_WORDS = (
    (("question", "inquiry", "uncertain", "maybe", "consider"), "uncertain"),
    (("resolve", "resolution", "decide", "commit", "therefore"), "assertive"),
    (("turn", "reframe", "contrast", "however", "but", "topic_shift"), "contrastive"),
    (("reflect", "reflection", "background", "setup"), "reflective"),
    (("risk", "problem", "failure", "concern", "conflict"), "tense"),
    (("benefit", "opportunity", "success", "progress", "resolution"), "positive"),
)

# Transitions that continue a causal chain.
CAUSAL_TRANSITIONS = ("cause_to_decision", "decision_to_effect", "decision_to_implementation", "turn_to_resolution")

# Base strength of each event of the finite alphabet.
EVENT_STRENGTH = (
    ("persistence", 0.8), ("turn", 1.8), ("reframe", 2.4), ("topic_shift", 2.2), ("question", 1.7), ("resolution", 2.0), ("cause_to_decision", 2.3), ("tone_flip", 1.6),
)

# Amplitude of an edge in a volume by its type, and what its status adds.
EDGE_AMPLITUDE = (("allow", 1.5), ("block", 1.7), ("require", 1.4), ("trigger", 1.3), ("step", 1.5), ("flow", 1.6), ("conflict", 1.8), ("junction", 1.2))
STATUS_AMPLITUDE = (("realized", 0.35), ("blocked", 0.45), ("outside", 0.20))

# The thirteen directions of a tube.
DIRECTIONS = (
    (1, 0, 0), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1), (0, 1, 0), (0, 0, 1), (0, 1, 1), (0, 1, -1),
)

# The kernel that an event leaves in a volume, (dt, du, dv, share).
KERNEL = ((0, 0, 0, 1.0), (-1, 0, 0, 0.45), (1, 0, 0, 0.45), (0, -1, 0, 0.45), (0, 1, 0, 0.45), (0, 0, -1, 0.35), (0, 0, 1, 0.35))

#: Phrase rules for tests: (domain words, slot, label, any of these, all of these); a rule fires in a text of its domain.
TEST_PHRASE_RULES = (
    (("the", "der"), "allowed", "keep_reading", ("tion", "ung"), ()),
    (("the", "der"), "allowed", "skip_ahead", (), ("an", "er")),
    (("the", "der"), "forbidden", "stop_here", ("sto", "hal"), ()),
    (("the", "der"), "required", "cite_source", (), ("so",)),
    (("que", "les"), "allowed", "translate", ("es",), ()),
    (("que", "les"), "required", "keep_accents", ("é", "ó"), ()),
)
TEST_TONES = (("the", "assertive"), ("and", "contrastive"), ("que", "uncertain"), ("lich", "tense"), ("ing", "reflective"))

# Families of relations and the words that a relation's label holds, the first that fits.
FAMILIES = (
    ("decision", ("decision", "choose", "prefer", "switch", "replace", "commit")), ("transition", ("transition", "pivot", "change", "redirect", "turn")),
    ("origin", ("origin", "genesis", "start", "create", "founded", "born")), ("question", ("question", "ask", "uncertain", "inquiry")),
    ("principle", ("principle", "core", "fundamental", "essential")), ("causal", ("cause", "effect", "condition", "because", "since", "thus")),
    ("action", ("build", "implement", "update", "deploy", "migrate", "fix")),
)

# Kinds inside a family, by words of the label, and the kind without any of them.
FAMILY_KINDS = (
    ("decision", ((("prefer", "choose"), "preference"), (("switch", "replace", "migrate"), "switch")), "commit"),
    ("transition", ((("pivot", "turn"), "pivot"), (("contrast", "however", "but"), "contrast")), "shift"),
    ("origin", (), "setup"), ("question", (), "inquiry"), ("principle", (), "principle"), ("causal", (), "causal"), ("action", (), "implementation"),
)
