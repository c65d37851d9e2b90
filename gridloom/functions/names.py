"""Given names and their short forms, used wherever typed names are compared.

Both tables are fixed values: common given names and everyday nicknames.
"""

from __future__ import annotations

import unicodedata

GIVEN_NAMES = frozenset(
    """
    adrian albert alexander alexis alfred andre andreas anton arthur aurelio barnaby bastian benedict benjamin bernard
    bjorn bruno carlos caspar cedric clement conrad cyril damian daniel david dieter dominic duncan eduardo edward edwin
    elias emil enrico ernest esteban eugene fabian felix fernando florian francis frederick gabriel gaston george gerard
    gilbert gordon gregory gustav harold hector heinrich henrik horace hubert hugo ignacio isidor ivan jakob james
    jasper joachim jonas jose joseph julian jurgen kaspar kenneth klaus konstantin lambert laurent leonard leopold
    lionel lorenzo lucas ludwig magnus manuel marcel marius martin matteo maurice maximilian michael nathaniel nicholas
    norbert octavio olivier oscar otto pascal patrick peter philip quentin rafael ramon raymond reinhard rene richard
    robert roland rupert samuel sebastian severin sigmund simon stefan stephen sylvain theodore thomas timothy tobias
    ulrich valentin victor vincent walter werner william xavier yannick zoltan
    """.split()
)

#: short form -> the given names it may stand for
NICKNAMES: dict[str, tuple[str, ...]] = {
    k: tuple(v.split("/"))
    for k, v in (
        x.split(":")
        for x in """
    al:albert/alfred/alexander ade:adrian alex:alexander/alexis lex:alexis/alexander alf:alfred fred:frederick/alfred
    freddie:frederick/alfred andi:andreas andy:andreas toni:anton tony:anton art:arthur artie:arthur barney:barnaby
    basti:bastian/sebastian seb:sebastian ben:benedict/benjamin bernie:bernard carlitos:carlos charlie:carlos clem:clement
    con:conrad connie:conrad damo:damian dan:daniel danny:daniel dave:david davy:david dom:dominic nic:nicholas edu:eduardo
    ed:edward/edwin/eduardo eddie:edward/edwin ted:edward/theodore/edwin teddy:edward/theodore ernie:ernest gene:eugene
    fabi:fabian nando:fernando flo:florian frank:francis gabe:gabriel gerry:gerard gil:gilbert greg:gregory gus:gustav
    harry:harold/henrik hal:harold heinz:heinrich heini:heinrich nacho:ignacio izzy:isidor jim:james jimmy:james
    jochen:joachim achim:joachim joe:joseph pepe:jose/joseph jules:julian ken:kenneth kenny:kenneth konni:konstantin
    kostja:konstantin kosta:konstantin len:leonard lenny:leonard leo:leopold/leonard renzo:lorenzo luke:lucas lutz:ludwig
    wiggerl:ludwig manny:manuel manolo:manuel marty:martin matt:matteo mo:maurice max:maximilian maxi:maximilian
    mike:michael mick:michael nat:nathaniel nate:nathaniel nick:nicholas nico:nicholas/nicholas ossie:oscar oskar:oscar
    pat:patrick paddy:patrick pete:peter phil:philip pip:philip rafa:rafael ray:raymond reini:reinhard reiner:reinhard rainer:reinhard dick:richard
    rick:richard rich:richard bob:robert rob:robert bobby:robert rolli:roland sam:samuel sammy:samuel sigi:sigmund
    siggi:sigmund steve:stephen stef:stefan theo:theodore tom:thomas tommy:thomas tim:timothy tobi:tobias uli:ulrich
    val:valentin vic:victor vince:vincent walt:walter wally:walter bill:william will:william billy:william xavi:xavier
    jojo:joachim hugh:hugo chris:christopher kas:kaspar jürg:jurgen tavi:octavio ollie:olivier oli:olivier quique:enrico
    rico:enrico pancho:francis bert:albert/hubert/lambert/gilbert/norbert hub:hubert norb:norbert nobby:norbert enzo:lorenzo/enrico/vincent kostya:konstantin moritz:maurice
    """.split()
    )
}


def fold(text: str) -> str:
    """Lower case without accents; letters that do not decompose keep a plain spelling."""
    out = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l"))
    return "".join(c for c in out if not unicodedata.combining(c)).lower()


def expand_given(token: str) -> tuple[str, ...]:
    """The given names that a folded token may stand for, itself included."""
    return (token, *NICKNAMES.get(token, ()))


def is_given(token: str) -> bool:
    return token in GIVEN_NAMES or token in NICKNAMES
