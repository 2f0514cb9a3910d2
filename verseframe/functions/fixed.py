"""Word lists, patterns, thresholds and texts that results depend on."""

# fixed values: imagery words (one is listed twice in the source list, which makes no difference)
IMAGERY = (
    "mist", "moon", "sun", "river", "forest", "leaf", "leaves", "stone", "wind", "rain", "storm", "shadow", "shadows", "light", "glow", "flame", "ash", "snow", "ice",
    "ocean", "sea", "wave", "waves", "sky", "cloud", "clouds", "flower", "flowers", "petal", "petals", "dust", "smoke", "ember", "root", "roots", "tree", "trees",
    "bird", "birds", "wolf", "wolves", "deer", "feather", "feathers", "scent", "fragrance", "taste", "bitter", "sweet", "sour", "salt", "salty", "silence", "whisper",
    "whispers", "echo", "echoes", "breath", "breathing", "night", "dawn", "twilight", "dusk", "horizon", "stars", "star", "thunder", "fog", "moss", "soil", "earth", "garden",
)
# fixed values: verbs of motion and perception
MOTION = ("walk", "look", "see", "stand", "move", "turn", "stare", "watch", "glance", "hear", "listen", "run", "step", "wander")
# fixed values: chat tokens
CHAT_TOKENS = ("<|im_start|>", "<|im_end|>", "<|eot_id|>", "<|endoftext|>", "<|assistant|>", "<|user|>", "<|system|>")
# fixed values: words that do not count as content of a short phrase
ARTICLES = ("the", "a", "an", "this", "that", "these", "those")
# fixed values: words that may repeat within a line
MAY_REPEAT = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "at", "for", "with", "is", "are", "was", "were", "it", "its", "it's", "that", "this", "as", "by", "from", "be", "not",
    "he", "she", "they", "we", "you", "his", "hers", "me", "my", "your", "our", "us", "so", "if", "then",
)
# fixed values: stop words of the word-overlap measure
OVERLAP_STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "of", "for", "with", "these", "those", "is", "are", "was", "were", "it", "its", "it's", "that", "this", "as", "by", "from", "be",
    "not", "me", "you", "us", "her", "she", "he",
)
# fixed values: n-gram overlap limits by n
NGRAM_LIMITS = {2: 0.5, 3: 0.3, 4: 0.2}
# fixed values: filler words of the two speech agents
FILLER = ("the", "a", "an", "uh", "um", "oh", "ah")
EDGE_FILLER = ("the", "a", "an", "um", "uh", "er")
# fixed values: limits of a substantial utterance, and the silence that ends one
MIN_SPOKEN_WORDS, MIN_SPOKEN_CHARS, MIN_SPOKEN_CONTENT, SILENCE_SECONDS = 3, 10, 2, 2.5
# fixed values: lines that are page furniture, matched from their start without case
METADATA = (
    r"exported from wikisource.*", r"from wikisource.*", r"retrieved from .*wikisource.*", r"this page was last edited.*", r"downloaded from .*wikisource.*", r"source:\s*.*", r"license:\s*.*", r"category:\s*.*",
    r"\[[^\]]*(?:edit|contents|hide|show)[^\]]*\]", r"\d{1,2}\s+[a-z][a-z]+\s+\d{4}", r"[a-z][a-z]+\s+\d{1,2},\s+\d{4}", r"\d{4}-\d{2}-\d{2}", r"page\s+\d+", r"\d+",
)
METADATA_WORDS = ("wikisource", "project gutenberg")
METADATA_STARTS = ("proofreaders", "transcriber's note", "transcriber note")
RULE_LINE = r"[-=_*~]{3,}"
START_MARK, END_MARK = r"\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG", r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG"
# fixed values: markdown rules, applied in this order
MARKDOWN = (
    (r"\*\*\*(.+?)\*\*\*", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"), (r"(?s)`{3}.*?`{3}", ""), (r"`(.+?)`", "$1"), (r"(?m)^#{1,6}\s*", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^\s*[-*+]\s+", "  - "), (r"(?m)^\s*\d+\.\s+", "  "), (r"\[(.+?)\]\(.+?\)", "$1"), (r"!\[.*?\]\(.+?\)", ""), (r"(?m)^>\s*", "  "),
)
TOKEN_NOISE = r"(?i)<\|[^>]+\|?>|<[a-z_]+\|>|<[a-z_]+>|</[a-z_]+>|\[/?(?:channel|think|end_of_turn|bos|eos)[^\]]*\]"
# fixed values: instructions of a training chat
INSTRUCTIONS = (
    "Write a poem.", "Write an original poem.", "Compose a lyrical poem.", "Write a short poem.", "Write a poem in a literary style.", "Please write a poem for me.", "Could you write a poem?", "I'd love to read a poem.",
)
# fixed values: reasoning marks of model output
THINK_BLOCK, THINK_OPEN, THINK_CLOSE = r"(?is)<think\b[^>]*>.*?</think\s*>", r"(?is)<think\b[^>]*>.*\z", r"(?i)</think\s*>"
THINK_HEADER = r"(?i)^\s*(?:thinking process|thought process|reasoning|analysis|chain of thought|internal reasoning)\s*:"
FINAL_MARK = r"(?i)^\s*(?:final answer|final response|answer|response)\s*:\s*"
REASON_LIST = r"^\s*(?:\d+[.)]|[-*])\s+"
REASON_META = r"(?i)^\s*(?:the user|the prompt|i should|i need|i will|we should|we need|let me|first[,:\s]|second[,:\s]|third[,:\s])"
REASON_WORD = r"(?i)\b(?:user|prompt|question|answer|response|reasoning|analysis|step|should|need)\b"
LINGERING = r"(?i)(?:<think\b|</think>|thinking process\s*:|thought process\s*:|chain of thought\s*:|internal reasoning\s*:)"
FALLBACK = "I sing the bright wire at morning, and the human hand reaching through it for one more living spark."
OPEN_TAGS, CLOSE_TAGS = ("<|channel>", "<think>", "[channel]"), ("<channel|>", "</think>", "[/channel]")
# fixed values: vowels that may carry a rhyme
RHYME_VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
# fixed values: chunking budgets in tokens
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX, CHUNK_HARD, CHUNK_OVERLAP = 200, 600, 800, 2000, 0.15
