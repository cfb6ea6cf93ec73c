"""Fixed values of the canonical taxonomy: labels, anchors and patterns that decide results, in the order in which they are tried."""

# Fixed values from here to the end of the file.
# fmt: off
GENERIC = ('', 'general', 'unclassified', 'miscellaneous', 'basics', 'mixed')
TOPIC_ANCHORS = {
    "Current Affairs": ["domestic affairs", "summits & conferences"],
    "Logical Reasoning": ["seating arrangement", "blood relations", "puzzles & ranking", "series", "direction sense", "analogies", "coding-decoding", "statement & conclusion", "venn diagrams", "syllogisms", "syllogism", "synergisms", "input-output"],
    "Quantitative Aptitude": ["ratio and proportion", "data interpretation", "number system", "algebra & equations", "averages & mixtures", "percentages", "geometry & mensuration", "time, speed and distance", "statistics & probability", "profit and loss", "interest", "arithmetic", "time and work"],
    "English Language": ["para jumbles", "grammar & usage", "fill in the blanks", "vocabulary", "reading comprehension", "idioms & phrases", "one-word substitution", "sentence correction"],
    "History": ["ancient history", "medieval history", "modern history", "indian national movement", "indus valley civilization", "mughal empire", "mauryan empire", "gupta empire", "vedic period", "buddhism", "jainism", "world history", "post-independence india", "social reform movements", "gandhian thought & movements"],
    "Science & Technology": ["biology", "chemistry", "physics", "biotechnology", "space technology", "computer fundamentals", "information technology", "defence technology", "medical science", "inventions & discoveries", "nuclear technology", "programming basics", "operating systems"],
    "Polity": ["constitutional development", "fundamental rights", "parliament", "judiciary", "preamble", "elections & political parties", "local government", "president & executive", "emergency provisions", "criminal laws", "evidence act", "legal terminology", "legal definitions", "legal reforms", "electoral offences"],
}
TECHNICAL_ANCHORS = {
    "Electrical Engineering": ["circuit theory & network analysis", "electrical machines", "power systems", "power electronics", "measurements & instrumentation", "electromagnetic theory", "high voltage engineering", "electrical materials & wiring"],
    "Mechanical Engineering": ["thermodynamics & heat transfer", "strength of materials", "theory of machines & machine design", "manufacturing technology", "industrial engineering & management", "refrigeration & air conditioning", "engineering mechanics", "metrology & quality control"],
    "Civil Engineering": ["structural engineering", "geotechnical engineering", "transportation engineering", "irrigation & water resources", "concrete technology", "estimating & costing", "surveying & mapping", "construction materials & technology"],
    "Electronics & Communication Engineering": ["electronic devices & circuits", "digital electronics & logic design", "communication systems", "signals & systems", "microprocessors & microcontrollers", "vlsi design", "antenna & wave propagation"],
    "Computer Science & Engineering": ["data structures & algorithms", "database management systems", "computer networks", "software engineering", "theory of computation", "computer architecture & organization", "compiler design", "artificial intelligence & machine learning"],
    "Agriculture": ["soil science & agronomy", "horticulture & floriculture", "plant pathology & entomology", "agricultural economics & marketing", "seed technology & genetics", "animal husbandry & veterinary science", "farm machinery & engineering", "agricultural extension", "post-harvest technology"],
    "Forestry": ["forest management & policy", "silviculture", "forest botany & ecology", "wildlife management & conservation", "agroforestry & social forestry", "wood science & technology", "forest survey & mapping", "forest laws & administration"],
    "Commerce & Accountancy": ["financial accounting", "cost & management accounting", "business law & company law", "auditing & assurance", "taxation (direct & indirect)", "capital markets & securities"],
    "Law": ["criminal law & procedure", "civil law & procedure", "contract & tort law", "property & transfer law", "family law & personal law", "administrative law", "international law", "labour & industrial law", "evidence law"],
    "Public Administration": ["administrative theory & thought", "organisational behaviour", "public policy & analysis", "budgeting & financial administration", "e-governance & digital services", "rural & urban administration", "development administration", "comparative public administration", "accountability & ethics"],
}
TOPIC_FIXES = {"synergisms": "Syllogisms", "awards & records": "Awards & Honours"}
TOPIC_RULES = [
    (r"\bnewton'?s laws?|laws? of motion|momentum|angular momentum|net force|applied force|balanced forces?|unbalanced forces?\b", "Mechanics"),
    (r"\binertia|friction|work done|work[- ]energy|kinetic energy|potential energy|conservation of energy|projectile|velocity|acceleration|displacement\b", "Mechanics"),
    (r"\btelescope|microscope|lens|lenses|mirror|mirrors|convergent|divergent|convex|concave|optics|reflection of light|refraction of light|ray optics|light rays?\b", "Optics"),
    (r"\bcarrom(?: striker)?|coin pile|carrom coin\b", "Mechanics"),
    (r"\bresearch methodology|research limitations?|research implications?|research abstract|research title|research recommendations?\b", "Research Methodology"),
    (r"\bair pollution|water pollution|noise pollution|thermal pollution|plastic pollution|chemical pollution|mercury pollution|atmospheric pollution|ocean pollution|pollution control|pollution control boards?|pollution control acts?|pollution control devices?|pollution control initiatives|pollution control technologies|environmental pollution|pollutants?\b", "Pollution"),
    (r"\bbuddh(a|is|ism|ist|hist)\b", "Buddhism"),
    (r"\bjain(a|ism|ist)?\b", "Jainism"),
    (r"\bgandhi|gandhian|mahatma gandhi|non-cooperation|civil disobedience|quit india\b", "Gandhian Thought & Movements"),
    (r"\btelangana movement|formation of telangana|statehood movement\b", "Telangana Movement"),
    (r"\btelangana history|social history of telangana|history of telangana|ancient and medieval history of telangana\b", "Telangana History"),
    (r"\btelangana culture|arts and crafts|literary institutions|tribal culture|cultural aspects\b", "Telangana Culture"),
    (r"\bmaurya|ashoka|chandragupta maurya\b", "Mauryan Empire"),
    (r"\bmughal|akbar|jahangir|shah jahan|aurangzeb\b", "Mughal Empire"),
    (r"\bgupta\b", "Gupta Empire"),
    (r"\bvedic|rig ved|sam ved|yajur ved|atharva ved\b", "Vedic Period"),
    (r"\bindus|harapp(a|an)\b", "Indus Valley Civilization"),
    (r"\btribal welfare|tribal sub-?plan|tribal development schemes?|tribal welfare schemes?\b", "Tribal Welfare & Development"),
    (r"\btribal communities|tribes of india|tribal societies in india|tribal culture|tribal practices|tribal marriage customs|scheduled tribes population|scheduled tribes and their regions|tribal communities of india\b", "Tribal Communities"),
    (r"\bscheduled castes and scheduled tribes act|scheduled castes and tribes act|sc/st act\b", "SC/ST Protection Law"),
    (r"\bscheduled castes and tribes|scheduled castes|scheduled tribes|national commission for scheduled castes|national commission for scheduled tribes|declaration of scheduled tribes|commissions? for scheduled tribes|scheduled tribes committees?\b", "Scheduled Castes & Scheduled Tribes"),
    (r"\bcaste system|social stratification|social structure and castes|caste movements?|caste-based organizations?|madiga reservation porata samithi|socio-economic and caste census\b", "Caste & Social Stratification"),
    (r"\bsocial reforms?|social reform movements?|social reformers?\b", "Social Reform Movements"),
    (r"\bconstitution|constituent assembly\b", "Constitutional Development"),
    (r"\bfundamental rights|article 14|article 19|article 21|article 32\b", "Fundamental Rights"),
    (r"\bdirective principles|dpsp\b", "Directive Principles of State Policy"),
    (r"\bfundamental duties\b", "Fundamental Duties"),
    (r"\bparliament|lok sabha|rajya sabha\b", "Parliament"),
    (r"\bjudiciary|supreme court|high court|judicial review\b", "Judiciary"),
    (r"\bpreamble\b", "Preamble"),
    (r"\bbharatiya nyaya sanhita|bharatiya nagarik suraksha sanhita|bharatiya sakshya adhiniyam|criminal laws?|criminal procedure|evidence act|legal terminology|legal definitions|legal reforms|electoral offences?\b", "Criminal Laws"),
    (r"\bmonsoon|rainfall\b", "Monsoon & Rainfall"),
    (r"\briver|tributary|basin\b", "Rivers"),
    (r"\bsoil\b", "Soils"),
    (r"\bclimate change|global warming|greenhouse\b", "Climate Change"),
    (r"\bbiodiversity|iucn|red list|endangered|wildlife\b", "Biodiversity & Conservation"),
    (r"\becology|ecosystem|food chain|food web\b", "Ecology"),
    (r"\binflation|cpi|wpi\b", "Inflation"),
    (r"\bgdp|gnp|national income\b", "National Income"),
    (r"\bbudget|fiscal deficit|revenue deficit\b", "Budget & Fiscal Policy"),
    (r"\bmonetary policy|repo rate|reverse repo|crr|slr\b", "Monetary Policy"),
    (r"\bindustr(y|ies)|industrial corridors?|industrial policy|industrial production|industrial development|manufacturing|sez|special economic zone|msme\b", "Industries & Industrial Policy"),
    (r"\btelangana budget|state budgets?\b", "State Budget & Economy"),
    (r"\btelangana schemes?|government schemes?|state policies?|policy\b", "Government Schemes & Policies"),
    (r"\bseating arrangement|circular arrangement|linear arrangement|square arrangement\b", "Seating Arrangement"),
    (r"\bblood relation|family tree\b", "Blood Relations"),
    (r"\bsyllogisms?\b|synergism\b", "Syllogisms"),
    (r"\bcoding|decoding\b", "Coding-Decoding"),
    (r"\bseries\b", "Series"),
    (r"\bdirection sense|direction\b", "Direction Sense"),
    (r"\btime,? speed|distance|relative speed|boats? and streams?\b", "Time, Speed and Distance"),
    (r"\btime and work|work and wages|pipes and cisterns\b", "Time and Work"),
    (r"\bprofit|loss|discount|marked price\b", "Profit and Loss"),
    (r"\bsimple interest|compound interest\b", "Interest"),
    (r"\bpercentage\b", "Percentages"),
    (r"\bratio|proportion|partnership\b", "Ratio and Proportion"),
]
SUBJECT_RULES = [
    (r"\bspace technology|space missions?|isro|nasa|chandrayaan|mangalyaan|gaganyaan|pslv|gslv|rocket launch|satellite launch|space station|space exploration\b", "Science & Technology"),
    (r"\bemerging technologies|scientists? and their contributions|biotechnology|information technology|computer|software|hardware|programming\b", "Science & Technology"),
    (r"\bnewton'?s laws?|laws? of motion|momentum|angular momentum|inertia|friction|acceleration|velocity|displacement|projectile|work done|kinetic energy|potential energy|conservation of energy|carrom|telescope|microscope|lens|lenses|mirror|mirrors|convergent|divergent|convex|concave|optics\b", "Science & Technology"),
    (r"\bindus|harapp|vedic|maurya|gupta|mughal|buddh|jain|gandhi|gandhian|telangana movement|social reform|temples? and architecture|historical places|history of telangana|telangana history|festivals? of telangana|art and culture\b", "History"),
    (r"\btribal communities|tribal welfare|tribes of india|caste system|social stratification|social issues|vulnerable sections|transgender community issues\b", "Social Issues"),
    (r"\beconomy of telangana|telangana economy|indian economy|economics\b|\bindustr(y|ies)|industrial|msme|trade and commerce|trade policy|trade deficit|trade balance|trade war|gdp|inflation|budget|fiscal|monetary|policy resolution\b", "Economy"),
    (r"\bclimate|rainfall|river|tributary|soil|geography|agro-climatic|range|locations?\b", "Geography"),
    (r"\bbiodiversity|ecosystem|pollution|wildlife|environment|industrial disasters?\b", "Environment"),
    (r"\bconstitution|fundamental rights|directive principles|judiciary|parliament|preamble|bharatiya nyaya sanhita|bharatiya nagarik suraksha sanhita|bharatiya sakshya adhiniyam|criminal laws?|criminal procedure|evidence act|legal terminology|legal definitions|legal reforms|electoral offences?\b", "Polity"),
    (r"\bgovernment schemes?|state policies?|public policy|welfare schemes?\b", "Polity"),
    (r"\bnato|united nations|un\b|world bank|imf|wto|international organizations?|foreign policy|bilateral relations|multilateral\b", "Current Affairs"),
    (r"\bsports awards?|awards and honors?|books and authors?|languages of india|transport systems?|defence forces|military ranks|research institutions\b", "General Awareness"),
    (r"\bresearch methodology|research limitations?|research implications?|research abstract|research title|research recommendations?\b", "General Awareness"),
]
INDUSTRY = r"\bindustry\b|\bindustries\b|\bindustrial\b|industrial corridors?|industrial polic(y|ies)|industrial production|industrial development|manufacturing|sez|special economic zone|msme\b"
INDUS_HISTORY = r"\bindus valley|harappan civilization|harappan culture|indus civilization\b"
POLITY_RESCUE = r"\bgovernment of india act|reorganisation act|reorganization act|state reorganisation|state reorganization|concurrent list|union list|state list|ordinance|fundamental rights|judgment|judgements|court|judiciary|parliament|waqf|workmen'?s compensation act|forest rights act|manual scavengers|transgender persons|disabilities act|government orders?|g\.o\.|go 610|committees? and commissions?|union territories|religious laws?/acts?|social legislation|legal principles|rights of persons with disabilities|official secrets act|right to information act|migrant workmen|personal data protection|laws and acts|acts and laws|acts and reforms|law enforcement initiatives|national security laws|criminal laws?|evidence act|electoral offences?|state formation|state reorganization acts?\b"
CRIMINAL_LAW = r"\bbharatiya nyaya sanhita|bharatiya nagarik suraksha sanhita|bharatiya sakshya adhiniyam|criminal laws?|criminal procedure|evidence act|legal terminology|legal definitions|legal reforms|electoral offences?\b"
LOOSE = [
    (r"\s+", " "),
    (r"\s*\([^)]*\)\s*", " "),
    (r"\btelangana state specific\b", "Telangana Specific"),
    (r"\bstate specific\b", "State Specific"),
    (r"\btelangana culture and history\b", "Telangana History"),
    (r"\bhistory of telangana\b", "Telangana History"),
    (r"\btelangana specific\b", "Telangana Specific"),
    (r"\bcurrent affairs and events\b", "Current Affairs"),
    (r"\bscheduled castes and tribes\b", "Scheduled Castes & Scheduled Tribes"),
    (r"\bscheduled castes and scheduled tribes\b", "Scheduled Castes & Scheduled Tribes"),
    (r"\btribes of india\b", "Tribal Communities"),
    (r"\btribal societies in india\b", "Tribal Communities"),
    (r"\btribal communities\b", "Tribal Communities"),
    (r"^\s*caste movements and organizations\s*$", "Caste Movements"),
    (r"^\s*social reformers\s*$", "Social Reform Movements"),
    (r"^\s*social reforms?\s*$", "Social Reform Movements"),
    (r"\s+", " "),
]
SPACE = r"\bspace (technology|mission|exploration|research)|isro|nasa|chandrayaan|mangalyaan|gaganyaan|pslv|gslv|satellite launch|space station\b"
MECHANICS = r"\bnewton'?s laws?|laws? of motion|momentum|angular momentum|net force|applied force|balanced forces?|unbalanced forces?|inertia|friction|acceleration|velocity|displacement|projectile|work done|kinetic energy|potential energy|conservation of energy|carrom(?: striker)?|coin pile|carrom coin\b"
OPTICS = r"\btelescope|microscope|lens|lenses|mirror|mirrors|convergent|divergent|convex|concave|optics|reflection of light|refraction of light|ray optics|light rays?\b"
# fmt: on
