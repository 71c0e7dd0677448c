"""Sample competition used by the golden tests. Fixed values, as CSV text with a header."""

CAR = """car_num,model,drive_class
11,Mini,FWD
17,GR Yaris,4WD
18,MX-5,RWD
20,Camaro,RWD
22,MX-5,RWD
31,Charade,FWD
36,Swift,FWD
44,BRZ,RWD
"""

DRIVER = """driver_id,first_name,surname,date_of_birth,age,caregiver,car
120,Tina,Zheng,2005-05-05,18,,22
121,Li,Bao,,,,22
124,Dora,Watson,,,,31
135,Maggie,Atwood,,,,18
128,Alan,Montgomery,,,,36
129,Jack,Atwood,2011-08-18,12,135,18
132,Lucas,Morales,,,,17
133,Oliver,Ngatai,,,,44
137,Daniel,Celeste,,,,20
"""

COURSE = """course_id,name,image
A,Going Loopy,loopy.gif
B,Mum's Favourite,mums.gif
C,Walnut,walnut.gif
D,Hamburger,hamburger.gif
E,Shoulders Back,upright.gif
F,Cracked Fluorescent,fluoro.gif
"""

RUN = """dr_id,crs_id,run_num,seconds,cones,wd
120,A,1,60.61,,0
121,A,1,,,0
124,A,1,76.94,1,0
128,A,1,70.32,,0
129,A,1,58.72,7,1
132,A,1,60.38,,0
133,A,1,65.12,,0
135,A,1,41.64,,0
137,A,1,,,0
120,A,2,56,,0
121,A,2,69.7,,0
124,A,2,45.41,,0
128,A,2,65.38,,0
129,A,2,54.37,1,1
132,A,2,,,0
133,A,2,72.27,2,0
135,A,2,61.89,,1
137,A,2,49.16,,0
120,B,1,36.84,,0
121,B,1,42.18,,0
124,B,1,52.78,,0
128,B,1,36.26,,0
129,B,1,51.2,,0
132,B,1,39.9,,0
133,B,1,51.42,,0
135,B,1,,,0
137,B,1,44.98,,1
120,B,2,45.24,,0
121,B,2,45.58,,0
124,B,2,41.64,,0
128,B,2,47.6,,0
129,B,2,38.9,,1
132,B,2,38.36,,0
133,B,2,52.53,,0
135,B,2,44.07,,0
137,B,2,39.09,,0
120,C,1,50.03,,0
121,C,1,61.68,,0
124,C,1,45.92,,0
128,C,1,71.62,,0
129,C,1,77.43,,0
132,C,1,45.76,,0
133,C,1,76.32,2,0
135,C,1,61.93,,0
137,C,1,68.98,,0
120,C,2,64.78,,0
121,C,2,58.48,,0
124,C,2,54.46,,0
128,C,2,59.84,,0
129,C,2,44.99,,0
132,C,2,61.99,,0
133,C,2,61.31,,0
135,C,2,55.92,,0
137,C,2,63.47,,0
120,D,1,59.89,,0
121,D,1,50.29,,0
124,D,1,54.92,,0
128,D,1,63.7,,0
129,D,1,40.08,,0
132,D,1,59.82,,0
133,D,1,39.4,,0
135,D,1,43.02,,0
137,D,1,55.7,,0
120,D,2,64.89,,0
121,D,2,64.69,,0
124,D,2,56.37,,0
128,D,2,54.83,,0
129,D,2,42.49,,0
132,D,2,55.91,,0
133,D,2,39.97,,0
135,D,2,60.33,,0
137,D,2,46.37,,0
120,E,1,22.4,,0
121,E,1,25.14,,0
124,E,1,24.89,,0
128,E,1,37.38,,0
129,E,1,33.53,,0
132,E,1,23.71,,0
133,E,1,32.41,,0
135,E,1,26.49,,0
137,E,1,37.44,,0
120,E,2,34.51,,0
121,E,2,28.56,,0
124,E,2,35.8,,0
128,E,2,,,0
129,E,2,31.91,,0
132,E,2,27.33,,0
133,E,2,36.64,,0
135,E,2,22,,0
137,E,2,26.5,,1
120,F,1,40.14,,0
121,F,1,45.92,,0
124,F,1,45.62,,0
128,F,1,,,0
129,F,1,,,0
132,F,1,48.13,,0
133,F,1,49.48,,0
135,F,1,42.31,,0
137,F,1,49.47,,0
120,F,2,38.68,,0
121,F,2,42.7,,0
124,F,2,49.46,,0
128,F,2,,,0
129,F,2,,,0
132,F,2,37.6,,0
133,F,2,42.93,,0
135,F,2,50.42,,0
137,F,2,50.32,,0
"""

TABLES = {"car": CAR, "driver": DRIVER, "course": COURSE, "run": RUN}
