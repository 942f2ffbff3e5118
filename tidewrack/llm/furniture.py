"""Wording of site furniture: weak labels for blocks of a page.

The general wording is one teacher of the block labeller (problem 2), which
generalises from it; the other is which lines recur on pages of different
content. Where residue is judged (problem 1), furniture is set aside by the
general wording and that of single sites.
"""

from __future__ import annotations

import html
import re

# Words of site menus in English, German, French and Spanish.
MENU_WORDS = set(
    """
    home about|about us contact jobs careers press shop store search login|log in|sign in subscribe events topics team archive podcast newsletter news blog faq help rss sitemap
    startseite über uns|über uns kontakt presse laden suche anmelden abo termine themen archiv karriere hilfe
    accueil à propos|à propos boutique recherche connexion abonnement agenda thèmes archives équipe emplois aide
    inicio nosotros contacto prensa tienda buscar entrar suscripción temas archivo equipo empleo ayuda
    terms privacy imprint impressum datenschutz agb aviso legal|aviso legal privacidad mentions légales|mentions légales confidentialité
    """.replace("|", "\n").split()
)
MENU_PHRASES = {"about us", "log in", "sign in", "über uns", "à propos", "aviso legal", "mentions légales", "mein konto", "my account"}
# Lines that are furniture as a whole, as patterns, by kind.
WHOLE_LINE = [
    # navigation
    r"(?:toggle navigation|skip to (?:main )?content|menu|menü|menú|back to top|zum inhalt(?: springen)?|zur navigation|nach oben|aller au (?:contenu|menu)|haut de page|retour en haut|(?:saltar|ir) al contenido|volver arriba|navigation (?:umschalten|ein-/ausblenden)|navigation)",
    # consent
    r"(?:accept all|reject all|alle akzeptieren|tout accepter|aceptar todo)\b.*",
    r"(?:your privacy:|ihre privatsphäre|su privacidad|votre vie privée).*",
    # sharing
    r"(?:share this\b|share on social media|tweet \||like \d+ ·|compartir\b|partager\b|beitrag teilen|teilen\b|share \|).*",
    # subscription
    r"(?:never miss a post|inscrivez-vous|suscríbase|jetzt eintragen|subscribe to our|sign up for|no te pierdas|ne manquez|verpassen sie).*",
    # comments
    r"(?:leave a comment|comments are closed|\d+ comments?|\d+ kommentare?|\d+ commentaires?|\d+ comentarios?|laisser un commentaire|deje un comentario|kommentar schreiben|enable javascript to load the comments|kommentare sind geschlossen|les commentaires sont fermés|comentarios cerrados)\b.*",
    # advertising
    r"(?:advertisement|sponsored(?: content)?|ad – scroll to continue|article continues below|anzeige|werbung|werbung –.*|publicité|publicidad|la suite après la publicité|sigue después del anuncio|contenu sponsorisé|contenido patrocinado|gesponsert(?:er inhalt)?|der artikel geht unten weiter)",
    # foot of the page
    r"(?:©|\(c\)|copyright)\s.*",
    r"(?:impressum \||mentions légales|aviso legal \||terms \|).*",
    # letters
    r"(?:view this (?:letter|e-?mail) in your browser|trouble reading\?.*|voir en ligne|ver en (?:línea|el navegador)|voir dans le navigateur|im browser (?:ansehen|öffnen)|online ansehen|problèmes d'affichage.*|¿problemas para leer.*)",
    r"(?:unsubscribe\b|no longer interested\?|se désabonner|se désinscrire|darse de baja|cancelar (?:la )?suscripción|abmelden\b|abbestellen|vom rundbrief abmelden|plus envie\b|ya no le interesa|kein interesse mehr|you (?:receive|are receiving|get) this).*",
]
# Fixed values: (word that must occur, pattern of the line) of furniture told by what it contains.
CONTAINING = [
    ("cookie", r"(?!noscript).*\bcookies?\b.*(?:\bto\b|\bum\b|\bpour\b|\bpara\b|\.).*"),
    ("all rights reserved", r".*"),
    ("alle rechte vorbehalten", r".*"),
    ("tous droits réservés", r".*"),
    ("todos los derechos reservados", r".*"),
]
# Lines of single sites; the block labeller does not learn from them.
SITE_LINES = [
    r"(?:this site stores small files|by continuing to browse|al continuar acepta|en poursuivant, vous acceptez|mit der weiteren nutzung|diese (?:seite|website) speichert|ce site (?:enregistre|stocke)|este sitio (?:guarda|almacena)).*",
    r"(?:join \d+ readers|get our letter|enjoyed this\? subscribe|nuestra carta cada|ya somos \d+|déjà \d+ abonnés|notre lettre chaque|jeden \w+ unser rundbrief|schon \d+ leser).*",
    r"made with care in .*",
    r".* (?:is an independent publication\. |ist eine unabhängige |est une publication indépendante|es una publicación independiente).*",
]
# Heads of lists of other articles, and pointers to one other article.
RELATED_HEAD = r"(?:you may also like|related(?: posts| articles)?|most read(?: this week)?|recommended for you|more from .+|read next|popular(?: posts)?|lo más leído|más de .+|también le puede interesar|à lire aussi|les plus lus|plus de .+|meistgelesen|das könnte sie auch interessieren|mehr (?:von|aus) .+|vous aimerez aussi|auch interessant|weitere artikel|notas relacionadas|trending(?: now)?)"
POINTER = r"(?:(?:more|read (?:more|also|next)|see also|lire aussi|à lire aussi|voir aussi|lea también|léase también|más|vea también|véase también|mehr(?: dazu)?|lesen sie auch|siehe auch|mehr zum thema)\s?:|(?:read (?:also|next)|see also|lire aussi|à lire aussi|voir aussi|lea también|vea también|véase también|lesen sie auch|siehe auch)\s?[–—-])\s.+"
_WHOLE = re.compile(r"^(?:" + "|".join(WHOLE_LINE) + r")\s*$", re.I)
_SITE = re.compile(r"^(?:" + "|".join(SITE_LINES) + r")\s*$", re.I)
_CONTAINING = [(w, re.compile(f"^{p}$", re.I)) for w, p in CONTAINING]
_RELATED = re.compile(rf"^{RELATED_HEAD}\s*$", re.I)
_POINTER = re.compile(rf"^{POINTER}$", re.I)
_CRUMB = re.compile(r"^[^>.!?]{2,40} > [^>.!?]{2,60} > .+$")
_SPLIT = re.compile(r"\s*[|·•]\s*|\s{2,}|\]\([^)]*\)\s*")
_BULLET = re.compile(r"^\s*(?:[*•»›–-]|\d+[.)])\s+")
_TAG = re.compile(r"<[^>]*>")
_END = re.compile(r"[.!?…:][\"'»”)]?$")


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|title|noscript|template)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_OPENS = re.compile(r"<!--|<(script|style|title|noscript|template)\b[^>]*>", re.I)


def visible_lines(text: str) -> list[str]:
    """The visible text of each line of ``text``; nothing inside scripts, styles, titles and comments is visible."""
    lines = text.split("\n")
    if "<" not in text:
        return [" ".join(s.split()) for s in lines]
    out, until = [], None
    for s in lines:
        if until:
            at = s.lower().find(until)
            if at < 0:
                out.append("")
                continue
            end = at + 3 if until == "-->" else s.find(">", at) + 1 or len(s)
            s, until = s[end:], None
        s = _HIDDEN.sub(" ", s)
        if m := _OPENS.search(s):
            until = f"</{m.group(1).lower()}" if m.group(1) else "-->"
            s = s[: m.start()]
        out.append(visible(s))
    return out


def visible(line: str) -> str:
    """The visible text of a line: without tags, entities decoded, spaces joined."""
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


def is_menu(s: str) -> bool:
    """Whether a line consists of menu words only."""
    s = _BULLET.sub("", s)
    parts = [p.strip(" []").lower() for p in _SPLIT.split(s) if p.strip(" []")]
    return bool(parts) and all(p in MENU_WORDS or p in MENU_PHRASES for p in parts)


def is_furniture(s: str) -> bool:
    """Whether a visible line is furniture by its wording, that of single sites included."""
    return bool(general_furniture(s) or _SITE.match(s))


def general_furniture(s: str) -> bool:
    """Whether a visible line is furniture by wording that sites have in common."""
    if _WHOLE.match(s):
        return True
    low = s.lower()
    if any(w in low and p.match(s) for w, p in _CONTAINING):
        return True
    return bool(_RELATED.match(s) or _POINTER.match(s) or (" > " in s and _CRUMB.match(s)) or is_menu(s))


_DIGITS = re.compile(r"\d+")


def recurrent_lines(pages: list[list[str]], least: int = 3) -> set[str]:
    """Lines, numbers aside, that occur on pages of ``least`` different contents or more; ``pages`` are visible lines.

    The longest line stands for the content of a page, so that versions of one
    text count as one.
    """
    at: dict[str, set[str]] = {}
    for lines in pages:
        lines = [_DIGITS.sub("0", s) for s in lines]
        longest = max(lines, key=len, default="")
        for s in lines:
            if s and s != longest:
                at.setdefault(s, set()).add(longest)
    return {s for s, contents in at.items() if len(contents) >= least}


def weak_labels(lines: list[str], recurrent: set[str] = frozenset()) -> list[int]:
    """1 for furniture, 0 for article, -1 for lines without visible text; ``lines`` are visible texts in order."""
    out, listing = [], False
    for s in lines:
        if not s:
            out.append(-1)
            continue
        if general_furniture(s):
            listing = bool(_RELATED.match(s))
            out.append(1)
        elif listing and not _END.search(s):
            out.append(1)  # titles listed under such a head
        else:
            listing = False
            out.append(int(bool(recurrent) and _DIGITS.sub("0", s) in recurrent))
    return out
