"""Fixed word lists, markers and patterns of the text kernel. These values decide results."""

# Stop words (French, English and interrogatives): fixed values.
STOP_WORDS = sorted(
    set(
        """
    quel quelle quels quelles combien comment pourquoi quand quoi lequel laquelle ou
    what which how why when who whom whose where
    a ai au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma
    mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son
    sur ta te tes toi ton tu un une vos votre vous y d l n s c j m t est sont etre ete cette
    cet celui celle ceux plus moins tres bien alors donc car si comme sans sous entre chez
    the a an and or but of to in on at for with by from as is are was were be been being
    this that these those it its their his her our your my we you they he she i not no do
    does did done can could should would may might will shall have has had there here what
    which who whom when where why how all any each few more most other some such than too
    very s t don now
    """.split()
    )
)

# Pronoun endings that inversion glues to a verb, tested in this order: fixed values.
ENCLITICS = ("-t-il", "-t-elle", "-t-on", "-il", "-elle", "-on", "-ils", "-elles", "-je", "-nous", "-vous")

# Language markers: fixed values.
FRENCH_MARKERS = "les des une dans pour que qui est sont avec sur cette aux".split()
ENGLISH_MARKERS = "the and for that with this are was from have been will".split()

# Intent markers: fixed values.
INTENT_MARKERS = {
    "comparison": ("compare", "comparer", "comparaison", "difference", "differences", "versus", "vs", "plutot que", "par rapport", "mieux que", "ecart", "entre"),
    "drafting": ("redige", "rediger", "ecris", "ecrire", "draft", "write", "propose un", "genere", "formule", "mail", "courrier", "note de service"),
    "explanation": ("pourquoi", "explique", "expliquer", "why", "explain", "comment fonctionne", "how does", "raison", "justifie"),
    "extraction": ("liste", "lister", "list", "enumere", "extract", "extraire", "combien", "quels sont", "quelles sont", "montant", "date", "delai", "taux", "how many"),
    "summary": ("resume", "resumer", "synthese", "synthetise", "summary", "summarize", "overview", "vue d'ensemble", "en bref", "grandes lignes", "recapitule"),
}

# Question words that say nothing about the subject: fixed values.
GENERIC_TERMS = (
    "long longer last lasts end ends ended start starts take takes taken happen happens occur occurs "
    "apply applies cover covers mean means case cases duree dure durer passe arrive concerne sagit"
).split()

# Words that ask for a figure: fixed values.
NUMERIC_QUESTION = r"(?i)\b(combien|montant|delai|taux|pourcentage|nombre|date|plafond|budget|prix|how many|how much|amount|rate|deadline|percentage)\b"

# Markers of a question in French: fixed values.
FRENCH_QUESTION = (" quel", " quelle", " comment", " pourquoi", " quels", " quelles", " combien", " est-ce", " liste", " resume", " qui ", " ou ", " des ", " les ", " une ", " dans ")

# Markers of a declared lack of evidence, and of hedging: fixed values.
INSUFFICIENT_MARKERS = (
    "ne permettent pas de conclure", "n'est pas presente dans le corpus", "n'est pas présente dans le corpus",
    "verification complementaire est necessaire", "vérification complémentaire est nécessaire",
    "do not allow a conclusion", "not present in the available corpus", "further verification is required",
    "i don't know", "je ne sais pas",
)
HEDGE_MARKERS = (
    "il semble", "probablement", "peut-etre", "peut-être", "il est possible",
    "apparently", "it seems", "possibly", "likely", "i believe",
)

# Lines without content: fixed values.
BOILERPLATE = (
    r"^page\s+\d+(\s*(/|of|sur)\s*\d+)?$",
    r"^\d+\s*$",
    r"^[-_=*.\s]{3,}$",
    r"^(confidentiel|confidential|internal use only|tous droits reserves)\b.{0,40}$",
)
