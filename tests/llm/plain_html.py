"""Main text by hand: the blocks of articles, from a stack of open elements of which each is hidden or not."""

from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
SILENT = set("script style noscript template button select textarea iframe svg object head title".split())
AWAY = set("nav footer aside form menu dialog".split())
WORDS = set("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar widget widgets newsletter cookie popup comment comments related share social breadcrumb breadcrumbs subscribe".split())


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.now = [], [], []

    def flush(self):
        text, self.now = " ".join("".join(self.now).split()), []
        if text:
            self.out.append(text)

    def end_open(self, tag, within):
        """An open p or li ends where the next one begins, unless one of `within` is open inside it."""
        at = [i for i, (t, _) in enumerate(self.stack) if t == tag]
        if at and not any(t in within for t, _ in self.stack[at[-1] + 1 :]):
            self.flush()
            del self.stack[at[-1] :]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
            return
        if tag in BLOCKS:
            self.end_open("p", BLOCKS)
            if tag == "li":
                self.end_open("li", {"ul", "ol", "menu"})
            self.flush()
        if tag in VOID:
            return
        words = set(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split())
        hidden = tag in SILENT | AWAY or (tag not in ("html", "body", "main") and bool(words & WORDS))
        self.stack.append((tag, hidden or (tag == "header" and not self.inside())))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(t in BLOCKS for t, _ in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return

    def inside(self):
        return any(t == "article" for t, _ in self.stack)

    def handle_data(self, data):
        if self.inside() and not any(hidden for _, hidden in self.stack):
            self.now.append(data)


def plain_text(html):
    p = Plain()
    p.feed(html or "")
    p.close()
    p.flush()
    return "\n".join(p.out)
