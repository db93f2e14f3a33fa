"""Small public tables the expected results refer to.

Fixed values throughout: the counts in the tests follow from these rows.
"""

# Flu shot clinics: date, day, event, event type, zip, ward, latitude, longitude.
FLU = [
    ("09/22/2013", "Sunday", "Mars Hill Church", "Church", 60644, 29, 41.888066973, -87.7727922789),
    ("09/28/2013", "Saturday", "4th Ward-Prince Hall Grand Lodge", "Alderman", 60616, 4, 41.8178417036, -87.6063022609),
    ("09/30/2013", "Monday", "20th Ward-Apostolic Church of God", "Alderman", 60637, 20, 41.7799094938, -87.591627676),
    ("10/01/2013", "Tuesday", "1st Ward Office", "Alderman", 60647, 1, 41.9192937068, -87.6876139388),
    ("10/01/2013", "Tuesday", "Chicago Police Department - HQ", "CPD", 60653, 3, 41.8307016873, -87.6233953459),
    ("10/02/2013", "Wednesday", "30th Ward-Kilbourn Park", "Alderman", 60641, 30, 41.9445048533, -87.7395111091),
    ("10/02/2013", "Wednesday", "8th Ward Office", "Alderman", 60619, 8, 41.7391160335, -87.6047448232),
    ("10/03/2013", "Thursday", "21st Ward Office", "Alderman", 60620, 21, 41.7299276017, -87.6627457509),
    ("10/03/2013", "Thursday", "48th Ward Office", "Alderman", 60660, 48, 41.9827972394, -87.6598982829),
    ("10/04/2013", "Friday", "32nd Ward Office", "Alderman", 60614, 32, 41.930025458, -87.6753335365),
    ("10/05/2013", "Saturday", "41st Ward-Taft High School", "Alderman", 60631, 41, 41.9829885184, -87.7915383035),
    ("10/07/2013", "Monday", "9th Ward-Tuley Park", "Alderman", 60619, 6, 41.730082286, -87.6118188547),
    ("10/07/2013", "Monday", "40th Ward Office", "Alderman", 60659, 40, 41.9877231686, -87.7031353555),
    ("10/08/2013", "Tuesday", "43rd Ward-Sunrise Assisted Living", "Alderman", 60614, 43, 41.9316042012, -87.6445920327),
    ("10/09/2013", "Wednesday", "5th Ward-Don Nash Comm. Center", "Alderman", 60649, 5, 41.765929954, -87.5800094321),
    ("10/09/2013", "Wednesday", "Chicago Police Department - 5th District", "CPD", 60628, 9, 41.6927233639, -87.6045058667),
    ("10/11/2013", "Friday", "12th Ward-McKinley Park", "Alderman", 60608, 11, 41.8231525443, -87.6805621474),
    ("10/12/2013", "Saturday", "33rd Ward Office", "Alderman", 60618, 33, 41.9480810866, -87.7077125782),
    ("10/13/2013", "Sunday", "Villa Guadalupe Senior Service Inc.", "Church", 60617, 10, 41.7300152219, -87.5468659719),
    ("10/16/2013", "Wednesday", "36th Ward-Hiawatha Park", "Alderman", 60634, 36, 41.9440091272, -87.8274819284),
    ("10/17/2013", "Thursday", "50th Ward Office", "Alderman", 60649, 50, 41.9973735259, -87.704027242),
    ("10/17/2013", "Thursday", "46th Ward-Weiss Hospital", "Alderman", 60640, 46, 41.9668595507, -87.6491350421),
    ("10/18/2013", "Friday", "3rd Ward-Apostolic Faith Church", "Alderman", 60609, 3, 41.8248863539, -87.6214809941),
    ("10/18/2013", "Friday", "31st Ward-St. Genevieve Church", "Alderman", 60639, 31, 41.9257904881, -87.7486916825),
    ("10/19/2013", "Saturday", "19th Ward Office", "Alderman", 60643, 19, 41.7044043739, -87.6817068175),
    ("10/19/2013", "Saturday", "16th Ward-Hope Presbyterian", "Alderman", 60609, 16, 41.7832894663, -87.6593057019),
    ("10/20/2013", "Sunday", "St. Sabina Church", "Church", 60620, 17, 41.7515062648, -87.6542255653),
    ("10/22/2013", "Tuesday", "11th Ward-McGuane Park", "Alderman", 60608, 11, 41.8413489899, -87.6495076896),
    ("10/23/2013", "Wednesday", "25th Ward-Lozano Library", "Alderman", 60608, 25, 41.8576012333, -87.6611637648),
    ("10/23/2013", "Wednesday", "34th Ward Office", "Alderman", 60628, 34, 41.692331396, -87.6354431987),
    ("10/24/2013", "Thursday", "Chicago Police Department - 2nd District", "CPD", 60609, 3, 41.8018110912, -87.6305601801),
    ("10/25/2013", "Friday", "10th Ward-Knights of Columbus", "Alderman", 60617, 10, 41.6915835405, -87.5351333203),
    ("10/26/2013", "Saturday", "47th Ward-Sulzer Library", "Alderman", 60618, 47, 41.9629668594, -87.6846946537),
    ("10/26/2013", "Saturday", "Truman College", "Other", 60640, 46, 41.965267395, -87.6592379773),
    ("10/27/2013", "Sunday", "24th Ward-Greater Galilee Church", "Alderman", 60624, 24, 41.8640872443, -87.7201966598),
    ("10/27/2013", "Sunday", "Prosser Career High School", "Church", 60639, 37, 41.9200361301, -87.7610843209),
    ("10/28/2013", "Monday", "Chicago Police Department - 19th District", "CPD", 60618, 47, 41.9395520781, -87.6899565856),
    ("10/31/2013", "Thursday", "27th Ward Office", "Alderman", 60642, 27, 41.8960028555, -87.6647800341),
    ("11/01/2013", "Friday", "12th Ward-Boys and Girls Club", "Alderman", 60608, 12, 41.8465081508, -87.6997507706),
    ("11/01/2013", "Friday", "29th Ward Office", "Alderman", 60651, 29, 41.9019653796, -87.7702760005),
    ("11/02/2013", "Saturday", "Daley College", "Other", 60652, 13, 41.7568763948, -87.7223217383),
    ("11/02/2013", "Saturday", "Wright College", "Other", 60634, 38, 41.9585483456, -87.7869189888),
    ("11/02/2013", "Saturday", "Arturo Velasquez Institute", "Other", 60608, 25, 41.8411101754, -87.6854255447),
    ("11/04/2013", "Monday", "28th Ward-Garfield Center", "Alderman", 60612, 28, 41.8806531808, -87.7062600612),
    ("11/04/2013", "Monday", "13th Ward-West Lawn Park", "Alderman", 60629, 13, 41.7748650121, -87.7288422505),
    ("11/05/2013", "Tuesday", "42nd Ward-FUMC Chicago Temple", "Alderman", 60602, 42, 41.8831005395, -87.6303312119),
    ("11/06/2013", "Wednesday", "26th Ward-Humbolt Park", "Alderman", 60622, 26, 41.9077397333, -87.7014119111),
    ("11/07/2013", "Thursday", "2nd Ward-Old St. Marys Church", "Alderman", 60605, 2, 41.8618808148, -87.6241738232),
    ("11/07/2013", "Thursday", "Chicago Police Department - 25th District", "CPD", 60639, 29, 41.9186088912, -87.765574479),
    ("11/08/2013", "Friday", "39th Ward Office", "Alderman", 60630, 39, 41.9682408381, -87.7381318614),
    ("11/09/2013", "Saturday", "49th Ward Office", "Alderman", 60626, 49, 42.0155326387, -87.6682681105),
    ("11/09/2013", "Saturday", "37th Ward Office", "Alderman", 60639, 37, 41.9095562129, -87.7599625993),
    ("11/10/2013", "Sunday", "St Michael the Archangel Parish", "Church", 60609, 20, 41.8068085086, -87.6736572986),
    ("11/12/2013", "Tuesday", "44th Ward-Britton Senior Building", "Alderman", 60657, 44, 41.9341951658, -87.6414039381),
    ("11/13/2013", "Wednesday", "18th Ward Office", "Alderman", 60620, 18, 41.7461788457, -87.6829022633),
    ("11/14/2013", "Thursday", "Chicago Police Department - 11th District", "CPD", 60612, 24, 41.8735815216, -87.7055641792),
    ("11/15/2013", "Friday", "14th Ward-Polish Highlanders", "Alderman", 60632, 14, 41.8061421882, -87.7174279038),
    ("11/16/2013", "Saturday", "17th Ward Office", "Alderman", 60620, 17, 41.7520003511, -87.6536309698),
    ("11/16/2013", "Saturday", "7th Ward Burnham Math and Science Academy", "Alderman", 60649, 7, 41.7144017635, -87.5671672122),
    ("11/19/2013", "Tuesday", "38th Ward-Portage Park Senior Center", "Alderman", 60634, 38, 41.9551078677, -87.7622845814),
    ("11/20/2013", "Wednesday", "45th Ward-Lydia Home Assoc.", "Alderman", 60630, 45, 41.9532937609, -87.7484370772),
    ("11/24/2013", "Sunday", "St Francis of Assisi Church", "Church", 60608, 25, 41.8670351432, -87.6475220819),
    ("12/13/2013", "Friday", "City Hall", "Other Walk-In", 60602, 42, 41.8837645981, -87.6322753535),
    ("12/14/2013", "Saturday", "Ford City Mall", "Other Walk-In", 60652, 13, 41.7546601244, -87.7413847586),
    ("12/14/2013", "Saturday", "15th Ward Office", "Alderman", 60629, 15, 41.7789090127, -87.7000480109),
]
FLU_COLUMNS = ["date", "day", "event", "event_type", "zip", "ward", "latitude", "longitude"]

# Crimes of one day: id, date, code, latitude, longitude.
CRIMES = [
    (10271141, "2015-10-12 05:00:00", "0810", 41.761007606, -87.619983464),
    (10270780, "2015-10-12 00:00:00", "1310", 41.772582777, -87.731138849),
    (10271306, "2015-10-12 00:00:00", "1320", 41.84895498, -87.683109125),
    (10271260, "2015-10-12 00:00:00", "1150", 41.909955279, -87.626200461),
    (10271156, "2015-10-12 00:00:00", "1150", 41.879505465, -87.626683155),
    (10273614, "2015-10-12 17:00:00", "0910", 41.758659689, -87.683079488),
    (10272304, "2015-10-12 17:00:00", "1750", 41.800477928, -87.665973235),
]

RADIO = """Event Name,Date,lat,lon
foo,10/25/2015,41.6915835405,-87.5351333203
bar,10/27/2015,41.7915865543,-87.6495076896
baz,11/10/2015,39.5459890,-112.8956789
fizz,11/15/2015,41.89,-88.984
gorp,11/19/2015,42.545,-93.45342
"""
DOGS = """Hooded Figure ID,Date,lat,lon
1,10/25/2015,41.6915835405,-87.5351333203
2,10/27/2015,41.7915865543,-87.6495076896
3,11/10/2015,39.5459890,-112.8956789
4,11/15/2015,41.89,-88.984
5,11/19/2015,42.545,-93.45342
"""
OPERA = """Event Name,Date,Location
foo,10/25/2015,"(42.288066973, -87.729512789)"
bar,10/27/2015,"(40.43564, -87.4327926789)"
baz,11/10/2015,"(41.888066973, -87.7322789)"
fizz,11/15/2015,"(41.875066973, -87.7678922789)"
gorp,11/19/2015,"(41.111066973, -87.5437922789)"
"""


def _box(x0, y0, x1, y1):
    return [[[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]]]


LOOP_RING = _box(-87.667894363403, 41.851662061565, -87.597513198853, 41.891799452396)
SOUTHEAST_RING = _box(-87.635364532471, 41.759788240995, -87.551593780518, 41.832479253552)
LOOP = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": LOOP_RING}}
LOOP_AND_SOUTHEAST = {
    "type": "Feature",
    "properties": {},
    "geometry": {"type": "MultiPolygon", "coordinates": [LOOP_RING, SOUTHEAST_RING]},
}
