"""Fixed values of the sample format and the tunable defaults around them."""

from __future__ import annotations

# --- Fixed values: literals of the prompt and sequence format. ---------------------------------

BEGIN_OF_TEXT = "<|begin_of_text|>"
END_OF_TEXT = "<|end_of_text|>"
START_HEADER = "<|start_header_id|>"
END_HEADER = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"

IMAGE_PLACEHOLDER = "<|reserved_special_token_0|>"
IMAGE_NEWLINE = "<|reserved_special_token_1|>"
BOX_OPEN_TOKEN = "<|reserved_special_token_2|>"
BOX_CLOSE_TOKEN = "<|reserved_special_token_3|>"
POINT_OPEN_TOKEN = "<|reserved_special_token_4|>"
POINT_CLOSE_TOKEN = "<|reserved_special_token_5|>"

BOX_OPEN_TAG = "<box>"
BOX_CLOSE_TAG = "</box>"
POINT_OPEN_TAG = "<point>"
POINT_CLOSE_TAG = "</point>"

CAPTION_INSTRUCTIONS = [
    "Analyze the image in a comprehensive and detailed manner.",
    "What's happening in the scene?",
    "Write a terse but informative summary of the picture.",
    "What are the key elements in this picture?",
    "Present a compact description of the photo's key features.",
    "What do you think is going on in this snapshot?",
    "Describe the following image.",
    "What do you see happening in this image?",
    "Provide a brief description of the given image.",
    "What is this photo about'?",
    "Summarize the visual content of the image.",
    "What is in the photo?",
    "Write a detailed description of the given image.",
    "Can you elaborate on the elements of the picture provided?",
    "Give a brief description of the image.",
    "Explain the visual content of the image in great detail.",
    "Render a clear and concise summary of the photo.",
    "Describe the image concisely.",
    "Give a short and clear explanation of the subsequent image.",
    "Can you describe the main features of this image for me?",
    "Share a concise interpretation of the image provided.",
    "What is this?",
]

LOW_RES_IMAGES = 1
LOW_RES_POSITIONS = 577
HIGH_RES_IMAGES = 40
HIGH_RES_POSITIONS = 37
RESERVED_GENERATION = 10
MAX_POSITIONS = 16384
NO_PATCH = -1
IGNORED_LABEL = -100
ROOTED_IMAGE_PREFIX = "/data/"
DEFAULT_HQ_PREFIXES = ["cc3m", "llava_pretrain", "shareGPT4V"]
BUFFER_ROWS = 1000
TEXT_EVERY = 10
MATH_EVERY = 50
SHORTEST_EDGE = 336
POOL_SIDE = 24
POOL_WINDOW = 4

# --- Vocabulary ids. BOS and EOS belong to the format; the others follow the public vocabulary
# of the Llama 3.1 tokenizer and may be replaced by the caller. --------------------------------

BOS_ID = 128000
EOS_ID = 128001
PAD_ID = EOS_ID
HASHED_IDS = 128000

SPECIAL_IDS = {
    BEGIN_OF_TEXT: BOS_ID,
    END_OF_TEXT: EOS_ID,
    IMAGE_PLACEHOLDER: 128002,
    IMAGE_NEWLINE: 128003,
    BOX_OPEN_TOKEN: 128005,
    START_HEADER: 128006,
    END_HEADER: 128007,
    END_OF_TURN: 128009,
    BOX_CLOSE_TOKEN: 128011,
    POINT_OPEN_TOKEN: 128012,
    POINT_CLOSE_TOKEN: 128013,
}

# --- Tunables. ---------------------------------------------------------------------------------

# A token is a special marker, a run without white space or "<", or a lone "<".
TOKEN_PATTERN = r"<\|[a-z0-9_]+\|>|[^ \t\n\x0B\f\r<]+|<"

# A helper table is only hinted for broadcast when its row count is bounded by parameters
# (ranks, epochs, buckets) below this limit; past it the join stays co-partitioned.
BROADCAST_ROWS = 100_000

# The most used tokens of a vocabulary, which go to the rows that hold them; as many rows at most.
FREQUENT_TOKENS = 65536

# Steps of a rank that a folder of a written feed holds.
STEPS_PER_RANGE = 1024
