"""Word lists and patterns that results depend on, in plain text and natural order."""

# Closed-class Marathi words in Devanagari.
MARATHI = """
आहे आहेस आहात आहोत आहेत होता होती होते होतं झालं झाला झाली झाले नव्हतं नव्हता नव्हती नव्हते नाही नाहीत नका
मी माझा माझी माझे माझं तुझा तुझी तुझं आम्ही आपण तू त्याला तिला त्यांना आपल्याला तुम्हाला आम्हाला मला तुला
त्याचं तिचं तुमचं यांना यांचं काय कसं कशी कशा कोण कुठे कधी इकडे तिकडे इथे तिथे हवं पाहिजे
हे ते हा ही जो जी जे त्या या आणि पण किंवा नाहीतर तर मग म्हणून कारण एकदा दोनदा जरी
वरती वर खाली पुढे मागे मध्ये सोबत सकाळी दुपारी संध्याकाळी आज उद्या काल
करतो करते करतोय करतेय करत करू बोलतो बोलते बोलतोय बोलू जातो जाते जाऊ येतो येते येऊ चालत चाललं चालला चालू चाल बघू ऐका
दिलं दिला दिली दिले दिलात घेतलं घेतला घेतली घेतले काढले काढलं काढला बघितलं बघितला बघितले सांगितलं सांगितला सांगितले
""".split()

# Closed-class Hindi words in Devanagari.
HINDI = """
है हैं था थी थे नहीं मैं मेरा मेरी मेरे तुम तुम्हारा हम आप तू उसे उसको उन्हें मुझे तुझे हमें
क्या कैसे कौन कहाँ कब और लेकिन या करता करती करते बोलता बोलती बोलते जाता जाती जाते आता आती आते रहा रही रहे हूँ हूं
""".split()

# The same in Latin letters, without words that are also English (the, main, mere, hum, hu, ya, maze, pan).
MARATHI_ROMAN = """
ahe aahe ahes aahet nahi nahin mi majha majhi majhe tuza tuzi amhi aapan mala tula amhala tyala tila aplyala tumcha tumchi tumch
kay kasa kashi kon kuthe kadhi ani varti var khali pudhe mage madhye karto karte kartoy kartey bolto bolte chalt chaltay chalal
jato jate yeto yete hota hoti hotam zala zali zale dil dilam dila dili dile ghetla kadhle kadhla baghitla sangitla
nav naav nahitar tar mag mhanun karan ekda sakali
""".split()
HINDI_ROMAN = """
hai hain tha thi nahi nahin mein mera meri tum tumhara aap usse usko unhe mujhe tujhe hume kya kaise kaun kahan kab aur lekin
karta karti karte bolta bolti bolte jata jati jate aata aati aate raha rahi rahe hoon naam
""".split()

# Word separators of lexical language id; \\w would split Devanagari marks off.
WORD_BREAK = r"[\s,.!?;:'\"()\[\]{}|/\\<>]+"

# Words that are no keywords.
STOP_WORDS_ENGLISH = """
the and for are but not you all can her was one two three our out his him has have had what when where who will with this that these
those then than there their them they from your yeah okay just like know think going right want need make sure well some would could
should about because very also into over more much been were does did get got say said see now how why any let lets yes actually
really basically thing things something anything everything here hey hello thanks thank please sorry maybe mean meeting team today
good great lot look looking might time item items next back first last come came take takes little bit kind sort even still same other
another both many few able around before after again away far way ways through coming getting
she its too anybody everybody somebody nobody lovely fantastic nice yep hmm everyone anyone someone which while where's there's that's
""".split()
STOP_WORDS_DEVANAGARI = """
का के की को है हैं हूं हूँ में से पर यह वह ये वो और कि तो ही भी नहीं था थे थी हो होगा होता होती करना करने किया
लिए एक अपने अपना इस उस कुछ सब जो मैं हम आप तुम क्या कैसे कहां कहाँ कब अब फिर जब अगर लेकिन बहुत थोड़ा सकते सकता चाहिए
आहे आहेत नाही मला मी तू तुम्ही आम्ही ती ते आणि पण म्हणून म्हणजे हा हे या त्या केले करा करू होते असे असं काही
सर्व वर मध्ये ला चा ची चे काय कसे कुठे आता मग जर पाहिजे शकतो शकते बरं
""".split()

# Scripts that are neither Latin nor Devanagari (Bengali to Malayalam blocks).
FOREIGN_SCRIPTS = r"[\x{0980}-\x{0D7F}]+"

# Romanised words restored beside Devanagari.
ROMANISED = {"aahe": "आहे", "ahet": "आहेत", "nahi": "नाही", "pan": "पण", "haye": "हाय", "shikshak": "शिक्षक"}

# Sounds that are no speech.
SOUNDS = """
cough coughs snort laughter laugh applause cheering throat clears gasp sigh chuckle giggle groan yawn whistle noise background music
sound silence snicker muffled
""".split()

# Short fillers that speech models make up.
SHORT_FILLERS = [
    "hello", "hi", "thank you", "thanks", "bye", "goodbye", "subtitles by", "subtitles", "amara.org", "blank_audio", "thank you for watching", "see you next time",
]

# Leading fillers of titles.
FILLERS = ["uh", "um", "oh", "well", "so", "yeah", "okay", "right", "really", "in fact", "i mean", "like", "you know", "look", "listen", "पण", "आणि", "नाही", "म्हणजे", "असं", "ते", "ह्या", "हे"]

# Words that greet or introduce nobody in particular.
NOT_NAMES = """
everyone everybody guys all there team folks sir maam ma'am friend friends anyone anybody people students here again back today well
so now too also welcome
""".split()

# How speakers introduce themselves and greet others, in order of trial.
INTRODUCTIONS = [
    r"(?i)\bmy\s+name\s+is\s+([A-Za-z][A-Za-z'-]{1,40})\b",
    r"(?i)\bthis\s+is\s+([A-Za-z][A-Za-z'-]{1,40})\s+speaking\b",
    r"मेरा\s+नाम\s+([^\s,।.!?]+)",
    r"माझ[ेंं]\s+नाव\s+([^\s,।.!?]+)",
    r"माझं\s+नाव\s+([^\s,।.!?]+)",
]
_GREETING = r"(?:good\s+morning|good\s+afternoon|good\s+evening|hello|hi|hey|नमस्ते|नमस्कार|सुप्रभात|शुभ\s+प्रभात|शुभ\s+सकाळ|शुभ\s+संध्याकाळ|हॅलो|हैलो)"
GREETINGS = [rf"(?i)\b{_GREETING}\s+([A-Za-z][A-Za-z'-]{{1,40}})\b", rf"{_GREETING}\s+([ऀ-ॿ][ऀ-ॿ\-]{{1,30}})"]
# Fixed value: the plainer greeting by which a page decides that a transcript needs repair.
PLAIN_GREETING = r"(?i)(?:good\s+(?:morning|afternoon|evening)|hello|hi|namaste)\s+([A-Za-z][A-Za-z'-]+)"

# What models write for nothing.
NULLISH = ["", "null", "none", "not specified", "unspecified"]
NO_OWNER = ["", "null", "none", "unassigned", "unknown"]
FIRST_PERSON = ["i", "me", "my", "myself"]

# Decisions and actions that are none.
HYPOTHETICAL = ["might", "maybe", "could we", "could consider", "possibility", "hypothetically", "wanna see"]
FILLER_DECISIONS = ["yes, i will", "i know, i know, it's fine", "i know", "it's fine", "sure", "okay", "yes", "no", "yes, they are", "that's fine"]
SHORT_DECISIONS = ["budget", "marketing", "system", "plan", "decide", "agree", "policy", "approve", "postpone", "postponed", "launch"]
NO_ACTIONS = [
    "but they have to go", "that's quite a lot there", "are all the interviews this week", "yes, they are", "yes, i will",
    "just saying watch how much time it takes", "but what about my time on it", "no, i was going to do that today",
]
NO_ACTION_STARTS = ["are all", "should the", "can you let me"]

# Cue phrases of decisions and actions.
DECISION_CUES = [
    "we decided", "we've decided", "we have decided", "we agreed", "we've agreed", "decided to", "agreed to", "final decision", "let's go with",
    "lets go with", "we'll go with", "going with", "we will use", "we'll use", "sign off", "approved", "the plan is", "should come under",
    "will come under", "decided that", "budget allocation", "let's use", "lets use", "तय किया", "तय हुआ", "तय कर", "फैसला", "निर्णय", "तय है",
    "मंजूर", "स्वीकार", "निश्चित", "ठरवले", "ठरलं", "ठरव", "निर्णय घेतला", "मान्य", "ठरवायचं",
]
ACTION_CUES = [
    "action item", "follow up", "follow-up", "going to speak to", "going to get back", "i'll speak to", "interviewing", "interview",
    "proceed with caution", "prepare report", "by tomorrow", "by monday", "by friday", "करना है", "करेंगे", "करना होगा", "भेज दो", "भेजना है",
    "जिम्मेदारी", "करायचं", "करायचे", "करू", "पाठवा", "पाठवेन", "जबाबदारी", "पाहिजे",
]

# Words that mark a Devanagari line as Marathi.
MARATHI_MARKERS = ["आहे", "नाही", "पण", "माझे", "केले", "होते", "पान", "पानावर", "पाण्या", "नळाचं", "आणून", "ठरलं", "बरं"]

# File types that may be uploaded.
UPLOAD_TYPES = ["mp3", "wav", "mp4", "m4a", "webm", "ogg", "flac", "aac"]
