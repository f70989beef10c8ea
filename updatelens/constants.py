"""Fixed values that results depend on."""

# Words left out of keywords.
STOP_WORDS = (
    "a an and are as at be but by for from has have in into is it its of on or that the their "
    "they this to was were will with"
).split()

# Words that signal impact.
IMPACT_WORDS = (
    "breaking critical cve deprecated deprecation exploit incident launch major outage release "
    "security vulnerability"
).split()

# Length limits in characters.
TITLE_MAX = 800
EXCERPT_MAX = 4000
EXTERNAL_ID_MAX = 512
CONTENT_HASH_MAX = 128
URL_MAX = 2048
FEED_URL_MAX = 850
NAME_MAX = 200
TRACE_MAX = 512
VALIDATOR_MAX = 512
FAILURE_CODE_MAX = 128
REPRESENTATIVE_TITLE_MAX = 512
TOPIC_MAX = 256
CONTENT_BUDGET = 20000
FEED_BYTES_MAX = 1024 * 1024

# Limits of a generation request.
REQUEST_TOPIC_MAX = 200
REQUEST_TITLE_MAX = 512
REQUEST_EXCERPT_MAX = 4000
REQUEST_EXCERPT_BUDGET = 2000
REQUEST_INTEREST_NAME_MAX = 100
REQUEST_SOURCES_MAX = 50
REQUEST_INTERESTS_MAX = 100

# Limits of generated and stored brief text.
COMPOSED_TITLE_MAX = 200
COMPOSED_SUMMARY_MAX = 2000
COMPOSED_WHY_MAX = 1000
SNAPSHOT_TITLE_MAX = 512
SNAPSHOT_TOPIC_MAX = 256
SNAPSHOT_TEXT_MAX = 4000

# Names.
DEFAULT_TOPIC = "general"
ANALYZER_VERSION = "analyze-1"
GENERATION_VERSION = "generate-1"
SIMILARITY_VERSION = "similarity-1"
MESSAGE_DESTINATION = "content-processing"

# Item states.
TERMINAL_STATES = ("Processed", "Filtered", "FailedTerminal")
OPEN_STATES = ("Queued", "Processing", "FailedRetryable")

# IPv4 blocks that are not public addresses.
NON_PUBLIC_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 168.63.129.16/32 169.254.0.0/16 "
    "172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 "
    "198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"
).split()

# The wider IPv4 blocks refused when a feed is registered.
REFUSED_FEED_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 168.63.129.16/32 169.254.0.0/16 "
    "172.16.0.0/12 192.0.0.0/16 192.88.0.0/16 192.168.0.0/16 198.18.0.0/15 198.51.0.0/16 "
    "203.0.0.0/16 224.0.0.0/3"
).split()

ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"
