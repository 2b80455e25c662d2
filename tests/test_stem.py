from quarry.functions.stem import stem

# word: stem, from the examples of the published algorithm
CASES = """caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi
relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile
analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous
formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr
hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ homologous:homolog effective:effect bowdlerize:bowdler
probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil the:the dying:die"""


def test_published_examples():
    wrong = [(w, s, stem(w)) for w, s in (c.split(":") for c in CASES.split()) if stem(w) != s]
    assert not wrong
