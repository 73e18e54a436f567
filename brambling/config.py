"""Settings of the search library, each a plain default that can be replaced."""

from __future__ import annotations

from dataclasses import dataclass

# Needed as they are for equal results.
FILE_ENDINGS = (
    ".exe", ".xls", ".docx", ".doc", ".flv", ".img", ".ppt", ".iso", ".tz", ".eps", ".qcow2", ".deb", ".rpm",
    ".tzst", ".rar", ".lzo", ".lzma", ".odt", ".dmg", ".xlsx", ".mp4", ".swf", ".svg", ".gif", ".png", ".jpeg",
    ".tar", ".zst", ".mkv", ".7z", ".pkg", ".wmv", ".gz", ".apk", ".ps", ".msi", ".ai", ".zip", ".pptx", ".jpg",
    ".mp3", ".avi", ".mov", ".xz", ".php", ".pdf", ".lz", ".webm", ".bz2", ".tex", ".csv", ".json", ".xml", ".log",
    ".rtf", ".txt", ".css", ".js", ".ts", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".go", ".rb", ".apx",
)
UNWANTED_PATH_TERMS = (
    "imprint", "privacy", "cookie", "login", "download", "upload", "signin", "register", "checkout", "cart", "search",
    "edit", "script", "@", "readme", "terms", "conditions", "policy", "botc", "restricted", "email!", "newsletter",
    "subscribe", "unsubscribe", "eGuide", ":", ".it", ".fr", ".no", "/pdf/", "/src/", "/arxiv.org/format/",
    "/arxiv.org/html/", "/arxiv.org/ps/", "arxiv.org/show-email/",
)
EDITOR_TERMS = ("action=edit", "mode=edit", "start?", "/edit/", "/admin/", "/dashboard/")
BLACKLIST = (
    "www.google", "google.com", "www.bing", "www.yahoo", "www.duckduckgo", "www.youtube", "www.facebook", "www.instagram",
    "www.twitter", "www.linkedlin", "deepl.com", "twitter.com", "microsoft.com", "apple.com", "pinterest.com",
    "instagram.com", "linkedin.com", "youtube.com", "facebook.com", "duckduckgo.com", "reddit.com", "www.reddit",
    "tumblr.com", "www.tumblr", "flickr.com", "www.flickr", "snapchat.com", "www.snapchat", "vimeo.com", "www.vimeo",
    "dailymotion.com", "www.dailymotion", "medium.com", "www.medium", "quora.com", "bahn.de", "www.quora", "tiktok.com",
    "www.tiktok", "spotify.com", "www.spotify", "soundcloud.com", "www.soundcloud", "amazon.com", "www.amazon", "ebay.com",
    "www.ebay", "netflix.com", "www.netflix", "hulu.com", "www.hulu", "disneyplus.com", "www.disneyplus", "whatsapp.com",
    "amazon.com", ".it",
)
ENGLISH_PATHS = ("/en/", "/english/", "/en-de/")
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "th", "td", "li", "a", "blockquote")
DROPPED_TAGS = ("style", "script", "xmp", "iframe", "noembed", "noframes", "button", "src", "noscript", "form")
DECORATION_TAGS = ("span", "i", "b", "strong", "em", "u", "s", "strike")
CONTAINER_TERMS = ("content", "main")
#: Host: (tag, attribute, value) of its main node.
SITE_NODES = {
    "en.wikipedia.org": ("div", "id", "bodyContent"),
    "en.wikivoyage.org": ("div", "id", "mw-content-text"),
    "arxiv.org": ("div", "class", "leftcolumn"),
}
#: Nodes cut from a site's main node: spans all, sections the first of each.
SITE_SPANS = (("span", "class", "mw-whatlinkshere-tools"), ("span", "class", "mw-editsection"))
SITE_SECTIONS = (("div", "id", "catlinks"), ("div", "class", "printfooter"), ("ol", "class", "references"))
TOPIC_TERMS = ("tübingen", "tuebingen")
ENTITY_PHRASES = ("max planck institute",)
BLOCK_SEPARATOR = "\n;\n"
# Common English words without a topic.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "although", "am", "among", "an", "and", "any", "are",
    "as", "at", "be", "became", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can",
    "cannot", "could", "did", "do", "does", "doing", "done", "down", "due", "during", "each", "either", "else", "even",
    "ever", "every", "few", "for", "from", "further", "had", "has", "have", "having", "he", "hence", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "however", "i", "if", "in", "into", "is", "it", "its", "itself", "just",
    "less", "many", "may", "me", "might", "mine", "more", "most", "much", "must", "my", "myself", "neither", "never", "no",
    "nor", "not", "now", "of", "off", "often", "on", "once", "one", "only", "onto", "or", "other", "others", "our", "ours",
    "ourselves", "out", "over", "own", "per", "perhaps", "quite", "rather", "really", "same", "several", "she", "should",
    "since", "so", "some", "still", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there",
    "these", "they", "this", "those", "though", "through", "thus", "to", "together", "too", "toward", "under", "until",
    "up", "upon", "us", "very", "via", "was", "we", "well", "were", "what", "when", "where", "whether", "which", "while",
    "who", "whole", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours",
    "yourself", "yourselves",
)


@dataclass(frozen=True)
class SearchSettings:
    k1: float = 1.5
    b: float = 0.75
    fusion_weights: tuple[float, ...] = (0.3, 0.4, 0.3)
    feedback_docs: int = 5
    feedback_random: int = 0  #: extra documents by seeded hash; 3 as in an unseeded pick
    feedback_terms: int = 25
    results: int = 100
    cluster_weight: float = 0.6
    topic_weight: float = 0.4
    glue_first_pass: bool = False  #: join the first pass's terms without blanks
    seed: str = "feedback"


@dataclass(frozen=True)
class DuplicateSettings:
    similarity: float = 0.75
    pairwise_limit: int = 500  #: from so many documents on only equal prefixes are compared
    prefix_bits: int = 6


@dataclass(frozen=True)
class CrawlSettings:
    cache_limit: int = 20
    bucket_capacity: int = 10
    bucket_refill_s: float = 1.0
    german_below: float = 0.8  #: German pages stay below this detector score
    description_chars: int = 250
    keyword_chars: int = 10
    card_terms: int = 10
