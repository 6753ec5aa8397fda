"""Fixed values of the CommonMark, GFM and HTML specifications."""

# Names that open a block of raw HTML ending at a blank line.
HTML_BLOCK_TAGS = (
    "address", "article", "aside", "base", "basefont", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "iframe", "legend", "li",
    "link", "main", "menu", "menuitem", "nav", "noframes", "ol", "optgroup", "option", "p", "param", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "track", "ul",
)

# Tags that the tag filter disarms.
FILTERED_TAGS = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")
SAFE_SCHEMES = ("http", "https", "mailto", "tel")
