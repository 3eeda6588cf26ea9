"""Fixed values that results depend on: word lists, lookup tables, patterns and limits."""

from __future__ import annotations

# Media types and file extensions.
HLS_MIMES = ["application/vnd.apple.mpegurl", "application/x-mpegurl", "application/mpegurl", "audio/mpegurl", "audio/x-mpegurl"]
DASH_MIMES = ["application/dash+xml"]
GENERIC_MIMES = ["", "application/octet-stream", "binary/octet-stream", "text/plain", "application/force-download"]
VIDEO_EXTS = ["mp4", "m4v", "webm", "mkv", "mov", "flv", "avi", "ogv", "wmv", "3gp", "mpg", "mpeg"]
AUDIO_EXTS = ["mp3", "m4a", "ogg", "oga", "opus", "wav", "flac", "weba"]
SEGMENT_EXTS = ["ts", "m4s", "cmfv", "cmfa", "cmft", "aac", "ac3", "ec3", "vtt", "webvtt", "srt"]
SEGMENT_MIMES = ["video/mp2t", "video/iso.segment", "audio/aac", "audio/aacp"]
MIME_EXT = {
    "video/mp4": ".mp4", "video/x-m4v": ".m4v", "video/webm": ".webm", "video/quicktime": ".mov", "video/x-matroska": ".mkv", "video/x-flv": ".flv",
    "video/ogg": ".ogv", "video/3gpp": ".3gp", "video/mpeg": ".mpg", "video/x-msvideo": ".avi", "video/x-ms-wmv": ".wmv", "audio/mpeg": ".mp3",
    "audio/mp3": ".mp3", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a", "audio/aac": ".aac", "audio/ogg": ".ogg", "audio/opus": ".opus",
    "audio/webm": ".weba", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/flac": ".flac",
}

# Query parameters that change from request to request for the same file.
VOLATILE_PARAMS = [
    "range", "bytestart", "byteend", "bytes", "rn", "rbuf", "_", "rnd", "random", "cb", "nonce", "ts", "timestamp", "token", "tokens", "tok",
    "sig", "signature", "expires", "expire", "expiry", "exp", "e", "st", "hash", "md5", "policy", "key-pair-id", "hdnts", "hdnea", "auth",
    "authtoken", "auth_token", "access_token", "jwt", "se", "sp", "sv", "sr", "spr", "skoid", "sktid", "skt", "ske", "sks", "skv",
]
VOLATILE_PREFIXES = ["x-amz-", "x-goog-", "x-ms-"]

# Patterns (Java regular expressions).
IGNORED_HOST = r"(?i)(^|\.)googlevideo\.com\z"
STREAM_PIECE = r"(?i)(^|[-_.])init(ialization)?([-_.]|\z)|(^|[-_.])(seg|segment|chunk|frag|fragment)[-_.]?[0-9]"
NOT_MEDIA_MIME = r"^(text/(html|css|javascript|xml)|image/|application/(json|javascript|xml|xhtml\+xml|pdf|zip))"
TEXT_START = r'(?i)^\s*(?:<!doctype|<html|<head|<body|<\?xml|\{\s*"|\[\s*[\{"])'
IP_ADDRESS = r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z|^\[.*\]\z"
VIDEO_CODEC = r"(?i)^(avc[1-4]|hvc1|hev1|dvh[1e]|vp0?[89]|av01|mp4v)"
AAC_CODEC = r"(?i)^mp4a\.40\."
H264_CODEC = r"(?i)^avc[1-4]"
FRAGMENT_BOXES = ["styp", "moof", "sidx"]

TEMPLATE_TOKEN = r"\$[A-Za-z]*(?:%0[0-9]+d)?\$|[^$]+|\$"
MEDIA_PATH = r"(?i)\.(m3u8|mpd|mp4|m4v|webm|mkv|mov|flv|mp3|m4a|ogg|oga|opus|wav|flac)\z"
TEXTUAL_MIME = r"(?i)^(text/|application/(json|xml|xhtml))"

# What makes a text a file name: patterns and what is put in their place, in order; the longest name; reserved names.
NAME_RULES = [(r'[\x00-\x1f\x7f<>:"/\\|?*]', " "), (r"(?U)\s+", " "), (r"^ | \z", ""), (r"^\.+", ""), (r"[. ]+\z", "")]
MAX_NAME = 120
RESERVED_NAME = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])\z"

# Sentences that are results.
SAYS = {
    "refused": "The server refused the request (HTTP {status}). The link may have expired or the stream may be protected. Reload the original page, play the video again, and retry.",
    "gone": "The file is gone (HTTP {status}). Reload the original page and try again.",
    "status": "The server answered HTTP {status}.",
    "network": "Network error while contacting the server.",
    "blocked": "DRM-protected{systems}: this stream can't be downloaded.",
    "drm": "DRM-protected ({systems}): this stream can only be played by a licensed player and cannot be downloaded.",
    "nothing": "This manifest lists no downloadable video or audio.",
    "unreadable": "Could not read the manifest: {reason}",
    "entry": "Invalid SegmentTimeline entry",
    "duration": "Invalid SegmentTemplate duration",
    "undated": "The SegmentTemplate has neither a SegmentTimeline nor a duration.",
    "wall_clock": "This live stream addresses segments by wall-clock time, which is not supported.",
    "many": "The manifest lists too many segments",
    "scheme": "Unsupported URL scheme in manifest: {scheme}",
    "large": "XML document is too large",
    "doctype": "DOCTYPE declarations are not supported",
    "root": "Not a DASH manifest",
    "malformed": "Malformed XML",
    "deep": "XML is nested too deeply",
    "elements": "XML has too many elements",
    "playlist_large": "Playlist is too large",
    "playlist": "Not an HLS playlist",
    "refused_before": "This site refused Chrome's own downloader earlier, so the built-in downloader is used (it sends the page's Referer and cookies).",
    "playlist_scheme": "Unsupported URL scheme in playlist: {scheme}",
    "method": "Unsupported encryption method {method}.",
    "no_key": "Encrypted stream without a usable key URI.",
    "key": "Unexpected AES-128 key length ({n} bytes)",
    "format": "The stream changes format partway through (for example at an ad break), so it cannot be saved as one file in this format. Save it as .ts instead.",
    "no_moov": "The init segment has no moov box",
    "no_mvex": "Not a fragmented MP4 (no mvex): it cannot be merged",
    "offset": "Segments with an explicit base data offset cannot be merged",
}

# Names of protection systems by key format and by scheme.
HLS_SYSTEMS = {
    "com.apple.streamingkeydelivery": "FairPlay",
    "urn:uuid:94ce86fb-07ff-4f43-adb8-93d2fa968ca2": "FairPlay",
    "urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed": "Widevine",
    "com.widevine": "Widevine",
    "com.widevine.alpha": "Widevine",
    "com.microsoft.playready": "PlayReady",
    "urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95": "PlayReady",
}
DASH_SYSTEMS = {
    "urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed": "Widevine",
    "urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95": "PlayReady",
    "urn:uuid:94ce86fb-07ff-4f43-adb8-93d2fa968ca2": "FairPlay",
    "urn:uuid:e2719d58-a985-b3c9-781a-b030af78d30e": "ClearKey",
    "urn:uuid:5e629af5-38da-4063-8977-97ffbd9902d4": "Marlin",
    "urn:uuid:1077efec-c0b2-4d02-ace3-3c1e52e2fb4b": "CENC",
    "urn:mpeg:dash:mp4protection:2011": "CENC",
}

# Elementary stream types of a transport stream.
STREAM_TYPES = {
    0x01: ("MPEG-1 video", "video"), 0x02: ("MPEG-2 video", "video"), 0x03: ("MP3 audio", "audio"), 0x04: ("MP3 audio", "audio"),
    0x06: ("private data (e.g. AC-3/subtitles)", "other"), 0x0F: ("AAC audio", "audio"), 0x11: ("AAC (LATM) audio", "audio"),
    0x15: ("timed metadata", "metadata"), 0x1B: ("H.264 video", "video"), 0x24: ("HEVC (H.265) video", "video"), 0x81: ("AC-3 audio", "audio"),
    0x87: ("E-AC-3 audio", "audio"),
}
REMUXABLE_STREAM_TYPES = [0x1B, 0x0F, 0x15]

# Limits.
MIN_FILE_BYTES = 102_400
MAX_URL_LENGTH = 4096
MAX_MANIFEST_CHARS = 5_000_000
MAX_LINES = 200_000
MAX_SEGMENTS = 200_000
MAX_ELEMENTS = 200_000
MAX_DEPTH = 64
MAX_VARIANTS = 2_000
MAX_CHILD_URLS = 500
MAX_ITEMS = 40
MAX_REJECTED = 100
MAX_LOG = 80
MAX_PROBES = 30
PENDING_SECONDS = 20
RETRY_SECONDS = 10
PLAYLIST_SECONDS = 15
REPORT_MILLIS = 800
JOB_MINUTES = 60
ERROR_PAGE_BYTES = 16 * 1024
TEXT_ERROR_PAGE_BYTES = 512 * 1024
REQUEST_TYPES = ["main_frame", "sub_frame", "media", "xmlhttprequest", "object", "other"]
RETRY_CODES = ["SERVER_FORBIDDEN", "SERVER_UNAUTHORIZED", "SERVER_BAD_CONTENT", "SERVER_FAILED"]
SOURCE_RANK = {"element": 3, "timing": 2, "link": 1, "meta": 1}
