"""Labelled pages to learn from: drawn layouts, filled with words of the pages at hand.

No table says which blocks of a page are its article, so pages are made for which it is known. A drawn
page has an article in one of many containers, and menus, headers, sidebars, notices, adverts, forms, comments and
footers around and within it. Its words come from a bounded sample of the given pages, so that the words of
the language tell nothing, beside the customary phrases of such parts in four languages. Some pages lose
their telling elements and classes, so that the context has to tell.
"""

from __future__ import annotations

import random
import re

from .html_blocks import Block, read_blocks

# Stands before every text of the article in a drawn page; private use, so in no text.
_MARK = "\ue000"

# Customary phrases of pages.
MENU = "Home|About|About us|Contact|Blog|News|Shop|Archive|Login|Sign in|Register|Products|Services|FAQ|Help|Sitemap|Accueil|À propos|Contactez-nous|Actualités|Boutique|Connexion|Startseite|Über uns|Kontakt|Nachrichten|Anmelden|Impressum|Inicio|Acerca de|Contacto|Noticias|Tienda|Iniciar sesión".split("|")
FOOTER = "All rights reserved.|Privacy policy|Terms of use|Terms and conditions|Cookie settings|Powered by|Copyright|Imprint|Tous droits réservés.|Mentions légales|Politique de confidentialité|Alle Rechte vorbehalten.|Datenschutz|Impressum|AGB|Todos los derechos reservados.|Política de privacidad|Aviso legal|Follow us|Back to top".split("|")
NOTICE = "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our policy.|Accept all cookies|You have read all your free articles this month.|Please enable JavaScript.|Nous utilisons des cookies pour améliorer votre expérience.|Diese Website verwendet Cookies.|Wir verwenden Cookies.|Este sitio utiliza cookies.|Utilizamos cookies para mejorar su experiencia.|Subscribe to continue reading.|Breaking news|Your session has expired.".split("|")
ADVERT = "Advertisement|Sponsored|Buy now|Special offer|Limited offer: save 50%|Click here|Order today|Free shipping|Publicité|Offre spéciale|Achetez maintenant|Anzeige|Jetzt kaufen|Sonderangebot|Publicidad|Oferta especial|Compra ahora|Download the app|Try it for free".split("|")
FORM = "Subscribe|Subscribe to our newsletter|Your email|Email address|Search|Send|Submit|Password|Username|Remember me|Forgot password?|Name|Message|Abonnez-vous|Votre adresse e-mail|Rechercher|Newsletter abonnieren|Ihre E-Mail-Adresse|Suchen|Suscríbete|Tu correo electrónico|Buscar|Enviar".split("|")
SHARE = "Share|Tweet|Share this article|Facebook|Twitter|LinkedIn|WhatsApp|Email|Print|Copy link|Partager|Teilen|Drucken|Compartir|Like|Save".split("|")
RELATED = "Related articles|Read more|You may also like|Most read|Popular posts|Recent posts|Recommended|Latest news|Trending|Articles similaires|À lire aussi|Lire la suite|Ähnliche Artikel|Meistgelesen|Mehr zum Thema|Artículos relacionados|Lo más leído|Leer más|Tags|Categories|Archives".split("|")
COMMENTS = "Comments|Leave a comment|3 comments|12 Comments|Leave a reply|Join the discussion|Commentaires|Laisser un commentaire|Kommentare|Kommentar schreiben|Comentarios|Deja un comentario".split("|")
REPLY = "Reply|Report|Like|Répondre|Antworten|Responder|2 hours ago|yesterday|il y a 3 jours|vor 2 Tagen|hace 1 hora".split("|")
PAGES = "Previous|Next|Older posts|Newer posts|« Previous|Next »|1|2|3|Précédent|Suivant|Zurück|Weiter|Anterior|Siguiente".split("|")
# Customary classes and ids.
CONTENT = "content article article-body articleBody post post-content entry entry-content story story-body main main-content text body-text page-content blog-post td-post-content prose".split()
SIDE = "sidebar side widget widget-area aside right-column secondary rail".split()
ROUND = {
    "menu": ("nav", "menu nav navbar navigation topnav main-menu links site-nav breadcrumb breadcrumbs".split()),
    "head": ("header", "header site-header masthead top banner branding logo topbar".split()),
    "foot": ("footer", "footer site-footer bottom foot copyright colophon legal".split()),
    "notice": ("div", "cookie cookie-banner cookie-notice notice alert consent gdpr popup modal overlay paywall message".split()),
    "ad": ("div", "ad ads advert advertisement banner-ad sponsor sponsored promo promotion adsense".split()),
    "form": ("form", "form search search-form newsletter signup login subscribe contact-form".split()),
    "share": ("div", "share social sharing share-buttons social-links tools".split()),
    "related": ("aside", "related recommended popular recent more-news teaser trending read-more".split()),
    "comments": ("section", "comments comment-list comment-section discussion replies responses disqus".split()),
}
_TELLING = re.compile(r"<(/?)(nav|header|footer|aside|article|main|section|form)\b")


class Layout:
    """Draws one page."""

    def __init__(self, seed: int, words: list[str], sentences: list[str]):
        self.draw = random.Random(seed)
        self.words, self.sentences = words, sentences

    def some(self, low: int, high: int) -> range:
        return range(self.draw.randint(low, high))

    def phrase(self, low: int = 1, high: int = 4) -> str:
        return _escaped(" ".join(self.draw.choice(self.words) for _ in self.some(low, high)))

    def prose(self) -> str:
        """Sentences as they are, shorter and longer than the customary paragraph."""
        count = self.draw.choice([1, 1, 1, 2, 3, 5, 8])
        text = " ".join(self.draw.choice(self.sentences) for _ in range(count))
        style = self.draw.random()
        if style < 0.12:
            text = " ".join(text.split()[: self.draw.randint(1, 4)])
        elif style < 0.15:
            text = " ".join([self.draw.choice(self.words)] * self.draw.randint(2, 60))
        return _escaped(text)

    def names(self, kind: str) -> tuple[str, str]:
        """Element and attributes of a part."""
        tag, classes = ROUND[kind]
        tag = tag if self.draw.random() < 0.6 else "div"
        if self.draw.random() < (0.15 if tag != "div" else 0.85):
            key = self.draw.choice(["class", "class", "id"])
            return tag, f' {key}="{self.draw.choice(classes)}"'
        return tag, ""

    def part(self, kind: str, inside: str) -> str:
        tag, attributes = self.names(kind)
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def links(self, low: int, high: int, phrases: list[str], own: float = 0.6) -> str:
        names = [self.phrase(1, 3) if self.draw.random() < own else self.draw.choice(phrases) for _ in self.some(low, high)]
        anchors = [f'<a href="/{i}">{n}</a>' for i, n in enumerate(names)]
        style = self.draw.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in anchors) + "</ul>"
        return (" | " if style < 0.8 else " ").join(anchors) if style < 0.9 else "".join(f"<div>{a}</div>" for a in anchors)

    # What stands around an article.
    def menu(self) -> str:
        return self.part("menu", self.links(3, 9, MENU))

    def header(self) -> str:
        inside = f"<a href='/'>{self.phrase(1, 3)}</a>" if self.draw.random() < 0.5 else f"<div>{self.phrase(1, 3)}</div>"
        if self.draw.random() < 0.4:
            inside += f"<p>{self.phrase(2, 7)}</p>"
        if self.draw.random() < 0.4:
            inside += self.menu()
        return self.part("head", inside + (self.form() if self.draw.random() < 0.3 else ""))

    def footer(self) -> str:
        lines = [f"&copy; {self.draw.choice(['2019', '2021', '2023', '2024', ''])} {self.phrase(1, 3)}"] if self.draw.random() < 0.8 else []
        lines += [self.draw.choice(FOOTER) for _ in self.some(0, 3)]
        if self.draw.random() < 0.5:
            lines.append(_escaped(self.draw.choice(self.sentences)))
        joined = " &middot; ".join(lines) if self.draw.random() < 0.5 else "".join(f"<p>{x}</p>" for x in lines)
        return self.part("foot", joined + (self.links(2, 6, FOOTER, 0.2) if self.draw.random() < 0.4 else ""))

    def notice(self) -> str:
        text = self.draw.choice(NOTICE) if self.draw.random() < 0.7 else self.prose()
        button = "<button>OK</button>" if self.draw.random() < 0.4 else ""
        return self.part("notice", (f"<p>{text}</p>" if self.draw.random() < 0.5 else text) + button)

    def advert(self) -> str:
        text = self.draw.choice(ADVERT) if self.draw.random() < 0.4 else _escaped(self.draw.choice(self.sentences))
        inside = [text, f"<a href='//x'>{text}</a>", f"<p>{text}</p>", f"<span>{self.draw.choice(ADVERT)}</span><p>{text}</p>"]
        tag, attributes = self.names("ad")
        return f"<{tag}{attributes or ' class=ad'}>{self.draw.choice(inside)}</{tag}>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.draw.choice(FORM)}</label><input name=x>" for _ in self.some(1, 3))
        lead = f"<p>{self.draw.choice(FORM)}</p>" if self.draw.random() < 0.5 else ""
        return self.part("form", f"{lead}{fields}<button>{self.draw.choice(FORM)}</button>")

    def share(self) -> str:
        return self.part("share", self.links(2, 5, SHARE, 0.0))

    def related(self) -> str:
        heading = f"<h3>{self.draw.choice(RELATED)}</h3>"
        if self.draw.random() < 0.4:
            items = "".join(f"<div><a href='#'>{self.phrase(3, 9)}</a><p>{self.prose()}</p></div>" for _ in self.some(1, 4))
            return self.part("related", heading + items)
        return self.part("related", heading + self.links(2, 6, RELATED, 0.9))

    def sidebar(self) -> str:
        widgets = [self.draw.choice([self.related, self.form, self.advert, self.menu, self.about])() for _ in self.some(1, 4)]
        tag = "aside" if self.draw.random() < 0.6 else "div"
        return f'<{tag} class="{self.draw.choice(SIDE)}">{"".join(widgets)}</{tag}>'

    def about(self) -> str:
        return f'<div class="widget"><h4>{self.draw.choice(MENU)}</h4><p>{self.prose()}</p></div>'

    def comments(self) -> str:
        tag = self.draw.choice(["li", "div", "article", "p"])
        rows = ""
        for _ in self.some(1, 6):
            author = f"<b>{self.phrase(1, 2)}</b>" if self.draw.random() < 0.7 else ""
            said = f"<p>{self.prose()}</p>" if tag != "p" else self.prose()
            foot = f"<a href='#'>{self.draw.choice(REPLY)}</a>" if self.draw.random() < 0.4 else ""
            name = ' class="comment"' if self.draw.random() < 0.7 else ""
            rows += f"<{tag}{name}>{author} {said}{foot}</{tag}>"
        rows = f"<ol>{rows}</ol>" if tag == "li" else rows
        heading = f"<h{(n := self.draw.randint(2, 4))}>{self.draw.choice(COMMENTS)}</h{n}>" if self.draw.random() < 0.8 else ""
        tag, attributes = self.names("comments")
        if not attributes and not heading:
            attributes = ' id="comments"'
        return f"<{tag}{attributes}>{heading}{rows}{self.form() if self.draw.random() < 0.3 else ''}</{tag}>"

    def pages(self) -> str:
        return self.part("menu", self.links(2, 4, PAGES, 0.0))

    # The article.
    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in self.some(0, 2):
            at = self.draw.randrange(len(words))
            tag = self.draw.choice(["b", "em", "a", "strong", "i", "span", "code"])
            words[at] = f"<{tag}{' href=x' * (tag == 'a')}>{words[at]}</{tag}>"
        return " ".join(words)

    def paragraph(self, plain: str) -> str:
        style, text = self.draw.random(), _MARK + self.inline(self.prose())
        if plain == "soup" and style < 0.3:
            return f"<p><b>{text}<br>"
        if style < 0.72:
            return f"<{plain}>{text}</{plain}>" if plain != "soup" else f"<p>{text}</p>"
        if style < 0.80:
            return f"<h{(n := self.draw.randint(2, 4))}>{_MARK}{self.phrase(1, 8)}</h{n}>"
        if style < 0.87:
            tag = self.draw.choice(["ul", "ol"])
            rows = "".join(f"<li>{_MARK}{self.inline(self.prose()) if self.draw.random() < 0.6 else self.phrase(1, 5)}</li>" for _ in self.some(1, 6))
            return f"<{tag}>{rows}</{tag}>"
        if style < 0.91:
            return f"<blockquote>{text}</blockquote>" if self.draw.random() < 0.5 else f"<blockquote><p>{text}</p></blockquote>"
        if style < 0.94:
            rows = "".join("<tr>" + "".join(f"<td>{_MARK}{self.phrase(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in self.some(1, 4))
            return f"<table>{rows}</table>"
        if style < 0.97:
            return f"<p>{text}<br>{_MARK}{self.prose()}</p>"
        return f"<pre>{text}</pre>" if self.draw.random() < 0.5 else f"<figure><img src=x><figcaption>{_MARK}{self.phrase(2, 9)}</figcaption></figure>"

    def article(self) -> str:
        plain = self.draw.choice(["p", "p", "p", "div", "soup"])
        title = f"<h1>{_MARK}{self.phrase(2, 10)}</h1>" if self.draw.random() < 0.85 else ""
        if title and self.draw.random() < 0.15:
            title = f"<header>{title}</header>"
        lines = [self.paragraph(plain) for _ in self.some(1, self.draw.choice([2, 6, 14]))]
        if self.draw.random() < 0.05:
            lines += [self.draw.choice(lines)] * self.draw.randint(2, 20)
        for _ in self.some(0, 2):
            within = self.draw.choice([self.advert, self.share, self.related, self.form, self.notice])()
            lines.insert(self.draw.randint(0, len(lines)), within)
        inside = title + "".join(lines)
        style = self.draw.random()
        named = f'class="{self.draw.choice(CONTENT)}"' if self.draw.random() < 0.7 else f'id="{self.draw.choice(CONTENT)}"'
        if style < 0.4:
            return f"<article>{inside}</article>"
        if style < 0.5:
            return f"<main>{inside}</main>"
        if style < 0.6:
            return f"<main><article {named}>{inside}</article></main>"
        if style < 0.85:
            return f"<div {named}>{inside}</div>"
        if style < 0.92:
            return f"<div id=main><div {named}><section>{inside}</section></div></div>"
        return inside if style < 0.96 else f"<table><tr><td {named}>{inside}</td></tr></table>"

    def page(self) -> str:
        before = [self.menu, self.header, self.notice, self.advert, self.pages, self.sidebar, self.share, self.form]
        after = [self.footer, self.comments, self.related, self.sidebar, self.share, self.pages, self.advert, self.notice, self.form]
        first = [self.draw.choice(before)() for _ in self.some(0, 4)]
        last = [self.draw.choice(after)() for _ in self.some(0, 3)]
        first = [self.draw.choice([self.menu, self.header])()] * (self.draw.random() < 0.8) + first
        last += [self.footer()] * (self.draw.random() < 0.8)
        body = "".join([*first, self.article(), *last])
        if self.draw.random() < 0.25:
            body = _TELLING.sub(r"<\1div", body)
        if self.draw.random() < 0.15:
            body = re.sub(r' (?:class|id)="[^"]*"', lambda m: "" if self.draw.random() < 0.6 else m[0], body)
        if self.draw.random() < 0.5:
            body = f"<div id='{self.draw.choice(['page', 'wrapper', 'container', 'root'])}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.phrase(2, 8)}</title></head><body>{body}</body></html>"


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def drawn_page(seed: int, words: list[str], sentences: list[str]) -> tuple[str, list[Block], list[int]]:
    """A page, its blocks, and for each block whether it is of the article."""
    page = Layout(seed, words, sentences).page()
    blocks = read_blocks(page)
    labels = [int(_MARK in b.text) for b in blocks]
    for block in blocks:
        block.text = block.text.replace(_MARK, "")
    kept = [(b, x) for b, x in zip(blocks, labels, strict=True) if b.text]
    return page.replace(_MARK, ""), [b for b, _ in kept], [x for _, x in kept]


_OUTSIDE = {"nav", "aside", "footer", "form", "dialog"}


def told_by_markup(page: str, blocks: list[Block]) -> list[int] | None:
    """Labels of a page that names its article itself, by exactly one such element; else nothing."""
    if len(re.findall(r"<article\b", page, re.I)) != 1 or not re.search(r"</article\b", page, re.I):
        return None
    return [int("article" in b.path and not _OUTSIDE.intersection(b.path)) for b in blocks]


def material(pages: list[str]) -> tuple[list[str], list[str]]:
    """Words and sentences of pages, for drawn ones; customary words where there are none."""
    sentences = []
    for page in pages:
        for block in read_blocks(page):
            sentences += re.findall(r"[^.!?]+[.!?]+", block.text)[:8]
    sentences = sorted({" ".join(s.split()) for s in sentences if 2 <= len(s.split()) <= 60})
    if len(sentences) < 20:
        sentences += [f"The {a} of the {b} was {c}." for a, b, c in zip(_FEW, _FEW[3:] + _FEW[:3], _FEW[5:] + _FEW[:5], strict=True)]
    words = sorted({w for s in sentences for w in s.split()})
    return words, sentences


_FEW = "river house letter winter table garden engine number teacher village science market student paper window history water summer city road".split()
