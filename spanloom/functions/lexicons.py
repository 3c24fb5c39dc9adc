"""Phrase lists and patterns that results depend on. Every operator takes them as arguments."""

STRONG_MARKERS = (
    "sponsor", "sponsored", "sponsoring", "sponsorship", "brought to you by", "use code", "use my code", "promo code", "coupon code",
    "discount code", "link in the description", "link in the bio", "link below", "free trial", "affiliate link", "start your free",
    "sign up today", "today's video is brought",
)
WEAK_MARKERS = (
    "check out", "check them out", "head over to", "heading over to", "head to", "go to", "sign up", "signing up", "discount", "% off",
    "percent off", "thanks to", "shout out to", "deal", "offer", "get yours", "available at", "learn more",
)
BRAND_TEMPLATES = (
    r"sponsored\s+by\s+([A-Z][\w&'’.\-]*)",
    r"brought\s+to\s+you\s+by\s+([A-Z][\w&'’.\-]*)",
    r"(?:shout\s*out|thanks|thank\s+you)\s+to\s+([A-Z][\w&'’.\-]*)\s+for\s+sponsor",
    r"channel\s+sponsor\s+([A-Z][\w&'’.\-]*)",
    r"(?:today's|todays|this\s+video's)\s+sponsor(?:\s+is)?\s+([A-Z][\w&'’.\-]*)",
    r"sponsor(?:ed|ing)?\s*(?:by|is)?[:,]?\s+([A-Z][\w&'’.\-]*)",
)
BRAND_DOMAIN = r"\b([A-Za-z][\w\-]{2,})\s*\.\s*(?:com|co|io|net|org)\b"
BRAND_STOPLIST = (
    "the", "this", "that", "our", "their", "them", "today", "video", "channel", "sponsor", "sponsors", "watching", "everyone", "guys",
    "you", "and", "for", "all", "right", "so", "well", "also", "here", "there", "it", "its",
)
HOUSEKEEPING_MARKERS = (
    "subscribe", "subscribed", "hit the like", "like button", "smash that", "smash the", "notification bell", "notification squad",
    "ring the bell", "comment below", "in the comments below", "let me know in the comments", "merch", "patreon", "join this channel",
    "channel membership", "hit that bell", "turn on notifications",
)
TOPIC_MARKERS = (
    "so ", "so,", "now ", "now,", "okay", "ok,", "alright", "all right", "anyway", "anyhow", "moving on", "next ", "next,", "let me",
    "let's", "here is", "here's", "but here", "and here", "the point is", "the thing is", "my point", "look,", "listen,", "first,",
    "second,", "third,", "finally", "lastly", "in short", "to be clear", "bottom line", "the question is", "which brings", "that said",
    "meanwhile", "on the other hand", "by the way", "speaking of",
)
CLOSING_MARKERS = (
    "so that is", "so that's", "that is why", "that's why", "that is the", "that's the", "in other words", "which is why", "the lesson",
    "the takeaway", "bottom line", "and that is", "and that's", "thanks for", "thank you for", "see you", "i will see you",
)
PROMISE_MARKERS = (
    "one more thing", "saw coming", "coming up", "wait until", "wait for it", "you'll see", "you will see", "i'll show you",
    "let me show you", "the best part", "but first", "stay tuned", "here's where it gets", "heres where it gets", "which brings me",
    "you won't believe", "the craziest part", "and then it happened",
)
REVEAL_MARKERS = (
    "this is the", "this is it", "the first ", "introducing", "meet the", "say hello to", "it's called", "its called", "here it is",
    "and that is the", "turns out",
)
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "last", "other", "next", "final",
    "same", "latter", "former",
)
DEMONSTRATIVES = ("this", "that", "these", "those")
DANGLING_PRONOUNS = ("it", "its", "they", "them", "their", "he", "she", "his", "her", "this", "that", "these", "those", "both", "neither", "such")
BACKREFERENCES = (
    "as i said", "as i mentioned", "like i said", "like i mentioned", "as mentioned", "as above", "going back", "that is why",
    "which is why", "so that", "therefore", "for that reason", "the reason is",
)
STOP_NOUNS = ("thing", "things", "one", "ones", "way", "ways", "part", "parts", "time", "times", "case", "cases", "point", "points", "kind", "sort")
SENTENCE_END = r"[.!?…]$"
CLAUSE_END = r"[,;:—-]$"
