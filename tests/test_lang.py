import random

import pytest

from sheafline.lang import commands as C
from sheafline.lang.session import Session

FILES = {
    "EMPLOYEE.csv": "Ssn, Bdate, Sex, Salary, Super_ssn, Dno\n1,551208,1,25000,7,4\n2,650109,1,25000,6,5\n3,690329,0,25000,7,4\n4,271110,0,30000,6,5\n"
    "5,620915,0,38000,6,5\n6,551208,0,40000,8,5\n7,551208,1,43000,8,4\n8,720731,0,55000,0,1\n",
    "DEPARTMENT.csv": "Dnumber,Mgr_ssn,Mgr_start_date\n5,6,880522\n4,7,950101\n1,8,810619\n",
    "B.csv": "a, b\n1, 4\n2, 3\n3, 2\n4, 1\n",
    "A.csv": "a,b,c,d,e\n" + "".join(f"{i},{10 + i},{20 + i},{30 + i},{40 + i}\n" for i in range(1, 11)),
    "DUP.csv": "a,a\n1,2\n",
    "V.csv": "1,0,0,0\n0,1\n0.9,0.1,0,0,7\n0.5,0.5,0.5,0.5\n2,2,2,2\n",
    "G Nodes D.csv": "NodeID,A1,A2,A3,A4\n1,0,1,1,1\n2,1,1,0,1\n3,1,1,1,1\n4,1,1,1,1\n",
    "G Edges D.csv": "Src_NodeID,Dest_NodeID,Weight,B1,B2,B3,B4\n1,2,10,0,1,0,1\n1,3,12,1,1,1,1\n2,4,6,0,0,1,1\n3,4,20,1,1,1,1\n",
    "L Nodes U.csv": "NodeID,A1\n0,0\n1,0\n2,0\n3,1\n4,0\n",
    "L Edges U.csv": "S,D,W,B1\n0,1,1,0\n1,2,1,0\n2,3,1,0\n3,4,1,1\n",
    "sched.txt": "BEGIN T1\nREAD T1 A 0\nREAD T1 A 9\nWRITE T1 V 0\nCOMMIT T1\n",
    "inner.ra": "LOAD B\nP <- PROJECT b FROM B\n",
    "outer.ra": "SOURCE inner\nPRINT P\n",
    "loop.ra": "SOURCE loop\n",
}


@pytest.fixture()
def s(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    yield Session(spark, str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", keep)


def run(s, *lines):
    return [s.execute(x) for x in lines]


def column(s, name, i=0):
    return [line.split(", ")[i] for line in s.execute(f"PRINT {name}").split("\n")[1:-2]]


def test_load_print_sort_checksum(s):
    assert s.execute("LOAD EMPLOYEE") == "Loaded Table. Column Count: 6 Row Count: 8"
    assert s.execute("CHECKSUM EMPLOYEE") == "\nCHECKSUM EMPLOYEE : 0xD60E87FA2D738C17\nRows Hashed: 8"
    s.execute("LOAD DEPARTMENT")
    assert "0x71E97EDDCC5E49E8" in s.execute("CHECKSUM DEPARTMENT")
    assert s.execute("SORT EMPLOYEE BY Salary IN DESC;") == ""
    assert column(s, "EMPLOYEE") == list("87654123")
    s.execute("LOAD A")
    s.execute("SORT A BY b IN DESC TOP 3 BOTTOM 2")
    assert column(s, "A") == ["3", "2", "1", "4", "5", "6", "7", "8", "10", "9"]
    assert s.execute("PRINT A").endswith("Row Count: 10")


def test_joins_and_groups(s):
    run(s, "LOAD EMPLOYEE", "LOAD DEPARTMENT", "LOAD A", "LOAD B")
    s.execute("R <- JOIN EMPLOYEE, DEPARTMENT ON EMPLOYEE.Dno == DEPARTMENT.Dnumber WHERE EMPLOYEE.Salary > 30000 PROJECT EMPLOYEE.Ssn, EMPLOYEE.Salary, DEPARTMENT.Mgr_ssn;")
    assert sorted(s.execute("PRINT R").split("\n")[1:5]) == ["5, 38000, 6", "6, 40000, 6", "7, 43000, 7", "8, 55000, 8"]
    s.execute("J <- JOIN A, B ON A.a + B.b == 5 PROJECT A.a, A.c, B.b;")
    assert sorted(s.execute("PRINT J").split("\n")[1:5]) == ["1, 21, 4", "2, 22, 3", "3, 23, 2", "4, 24, 1"]
    s.execute("E <- JOIN A, B ON A.a + B.b == 100 PROJECT A.a;")
    assert s.execute("PRINT E") == "SEMANTIC ERROR: Relation doesn't exist"
    s.execute("G1, G2 <- GROUP BY Dno, Sex FROM EMPLOYEE HAVING AVG(Salary) > AVG(Super_ssn) RETURN MAX(Salary), COUNT(*)")
    assert s.execute("PRINT G1").split("\n")[:4] == ["Dno, MAXSalary", "1, 55000", "4, 43000", "5, 40000"]
    assert s.execute("PRINT G2").split("\n")[:3] == ["Sex, COUNT", "0, 5", "1, 3"]
    s.execute("G3 <- GROUP BY Sex FROM EMPLOYEE HAVING COUNT(*) > 0 RETURN AVG(Super_ssn)")
    assert s.execute("PRINT G3").split("\n")[1:3] == ["0, 6", "1, 7"]
    s.execute("N <- GROUP BY Sex FROM EMPLOYEE HAVING COUNT(*) > 99 RETURN COUNT(*)")
    assert s.execute("PRINT N").startswith("SEMANTIC")
    s.execute("S <- JOIN B, B ON B.a == B.b")
    assert s.execute("PRINT S").split("\n")[0] == "a, b, a, b"


def test_select_project_distinct_cross_rename(s):
    run(s, "LOAD EMPLOYEE", "LOAD B", "R <- SELECT Salary >= 38000 FROM EMPLOYEE", "X <- SELECT Salary > 99999 FROM EMPLOYEE")
    assert column(s, "R") == list("5678")
    assert s.execute("PRINT X").endswith("Row Count: 0")
    run(s, "P <- PROJECT Dno FROM EMPLOYEE", "D <- DISTINCT P", "C <- CROSS B B", "RENAME a TO z FROM B")
    assert column(s, "P") == list("45455541") and column(s, "D") == list("451")
    assert s.execute("PRINT C").split("\n")[0] == "B1_a, B1_b, B2_a, B2_b"
    assert s.execute("PRINT B").split("\n")[0] == "z, b"
    assert s.execute("RENAME z TO b FROM B") == "SEMANTIC ERROR: Column with name already exists"


def test_graphs(s, tmp_path):
    assert s.execute("LOAD GRAPH G D") == "Loaded Graph.Node Count:4,Edge Count:4"
    assert s.execute("RES <- PATH G 1 4 WHERE A3(N) == 1 AND B2(E)") == "TRUE 32"
    assert s.execute("PRINT GRAPH RES") == "3\n2\nD\n\n1,0,1,1,1\n3,1,1,1,1\n4,1,1,1,1\n\n1,3,12,1,1,1,1\n3,4,20,1,1,1,1"
    assert s.execute("R2 <- PATH G 1 4 WHERE A1(N)==1 AND A3(N) == 0 AND ANY(E)==1") == "FALSE"
    assert s.execute("R3 <- PATH G 1 4 WHERE A2(N) == 1") == "TRUE 16"
    assert s.execute("R4 <- PATH G 1 9") == "Node does not exist" == s.execute("DEGREE G 9")
    assert s.execute("DEGREE G 3") == "2"
    assert s.execute("RES <- PATH G 1 4") == "SEMANTIC ERROR: Resultant relation already exists"
    assert s.execute("LOAD GRAPH L U") == "Loaded Graph.Node Count:5,Edge Count:4"
    assert run(s, "DEGREE L 2", "U <- PATH L 4 0", "W <- PATH L 2 2", "Y <- PATH L 0 4 WHERE B1(E)") == ["2", "TRUE 4", "TRUE 0", "FALSE"]
    assert s.execute("PRINT GRAPH U").split("\n")[4:9] == ["4,0", "3,1", "2,0", "1,0", "0,0"]
    s.execute("EXPORT GRAPH RES")
    assert (tmp_path / "RES Edges D.csv").read_text().split("\n")[1] == "1, 3, 12, 1, 1, 1, 1"
    assert s.execute("LOAD GRAPH G D") == "SEMANTIC ERROR: Graph already exists"
    assert s.execute("LOAD GRAPH M D") == "SEMANTIC ERROR: Data file doesn't exist"


def test_vectors(s):
    assert s.execute("LOAD VECTOR MATRIX V 4") == "Loaded Matrix. Block Count: 1 Row Count: 5"
    assert s.execute("K <- KNN V QUERY_VEC [ 1.0, 0, 0, 0 ] TOP 3 METRIC MANHATTAN") == "KNN executed successfully. Results stored in K"
    assert s.execute("PRINT K").split("\n")[:4] == ["RecordID, Similarity_Score", "0, 0", "2, 2000", "1, 20000"]
    assert s.execute("K2 <- KNN V QUERY_VEC [ 1, 0 ] TOP 3 METRIC COSINE") == "Error: Query vector dimension mismatch."
    assert s.execute("K2 <- KNN Z QUERY_VEC [ 1, 0 ] TOP 3 METRIC COSINE") == "Error: Matrix not loaded."
    assert s.execute("K2 <- KNN V QUERY_VEC [ 1, 0, 0, 0 ] TOP 0 METRIC COSINE") == "SYNTAX ERROR"
    assert s.execute("LOAD VECTOR MATRIX V 4") == "SEMANTIC ERROR: Matrix already exists"


def test_catalogue(s, tmp_path):
    run(s, "LOAD B", "LOAD VECTOR MATRIX V 4", "LOAD GRAPH G D", "P <- PROJECT b FROM B")
    assert "Persisted      : NO (temporary)" in s.execute("DESCRIBE P")
    s.execute("EXPORT P")
    assert (tmp_path / "P.csv").read_text() == "b\n4\n3\n2\n1\n"
    assert "Persisted      : YES" in s.execute("DESCRIBE P")
    assert "Rows / Block   : 51" in s.execute("DESCRIBE V") and "DIRECTED" in s.execute("DESCRIBE G")
    assert s.execute("LIST TABLES") == "\nRELATIONS\nB\nP\n\nRow Count: 2"
    assert "G (D)" in s.execute("LIST GRAPHS") and "V [dim=4]" in s.execute("LIST MATRICES")
    before = s.execute("PRINT B")
    assert run(s, "INDEX ON a FROM B USING BTREE", "INDEX ON b FROM B USING HASH") == ["", "SEMANTIC ERROR: Table already indexed"]
    assert s.execute("PRINT B") == before and "Index Strategy : BTREE" in s.execute("DESCRIBE B")
    assert run(s, "CLEAR P", "CLEAR P") == ["", "SEMANTIC ERROR: No such relation exists"]


def test_scripts_and_schedules(s, tmp_path):
    assert s.execute("SOURCE outer").endswith("b\n4\n3\n2\n1\n\nRow Count: 4")
    assert "SEMANTIC ERROR" in s.execute("SOURCE loop")
    run(s, "LOAD A", "LOAD VECTOR MATRIX V 4")
    assert s.execute("TRANSACTION sched.txt") == "SEMANTIC ERROR: Page doesn't exist"
    assert "WRITE T1 V 0" in (tmp_path / "sched_output.txt").read_text()
    s.execute("QUIT")
    assert s.done


def test_errors(s):
    run(s, "LOAD EMPLOYEE", "LOAD B")
    cases = {
        "LOAD EMPLOYEE": "SEMANTIC ERROR: Relation already exists",
        "LOAD NONE": "SEMANTIC ERROR: Data file doesn't exist",
        "R <- SELECT x > 1 FROM B": "SEMANTIC ERROR: Column doesn't exist in relation",
        "R <- SELECT a > 1 FROM NONE": "SEMANTIC ERROR: Relation doesn't exist",
        "B <- PROJECT a FROM B": "SEMANTIC ERROR: Resultant relation already exists",
        "R <- CROSS B NONE": "SEMANTIC ERROR: Cross relations don't exist",
        "R <- JOIN B, EMPLOYEE ON B.a == B.b": "SEMANTIC ERROR: Column doesn't exist in relation",
        "R, R <- GROUP BY a, b FROM B HAVING COUNT(*) > 0 RETURN COUNT(*), COUNT(*)": "SEMANTIC ERROR: Resultant relation already exists",
        "R <- GROUP BY z FROM B HAVING COUNT(*) > 0 RETURN COUNT(*)": "SEMANTIC ERROR: Group By column doesn't exist in relation",
        "R <- GROUP BY a FROM B HAVING SUM(z) > 0 RETURN COUNT(*)": "SEMANTIC ERROR: Having column doesn't exist in relation",
        "R <- GROUP BY a FROM B HAVING SUM(b) > 0 RETURN MAX(z)": "SEMANTIC ERROR: Return column doesn't exist in relation",
        "SORT B BY z IN ASC": "SEMANTIC ERROR: Column doesn't exist in relation",
        "SORT B BY a IN ASC TOP 5": "SEMANTIC ERROR",
        "SETBUFFER 1": "SEMANTIC ERROR",
        "SETBUFFER 4": "",
        "DEGREE NONE 1": "SEMANTIC ERROR: Graph doesn't exist",
        "SOURCE none": "SEMANTIC ERROR: File doesn't exist",
        "TRANSACTION none.txt": "SEMANTIC ERROR: File doesn't exist",
        "EXPORT NONE": "SEMANTIC ERROR: No such relation exists",
        "DESCRIBE NONE": "SEMANTIC ERROR: Relation doesn't exist",
        "": "",
    }
    assert {k: s.execute(k) for k in cases} == cases


@pytest.mark.parametrize(
    "line",
    [
        "LOAD",
        "FOO",
        "A.a==B.b",
        "R <- PROJECT FROM B",
        "R <- SELECT a ~ 1 FROM B",
        "R <- SORT B BY a IN ASC",
        "SORT B BY a, b IN ASC",
        "SORT B BY a IN UP",
        "SORT B BY a IN ASC TOP x",
        "R <- JOIN A, B ON A.a > B.b",
        "R <- JOIN A, B ON A.a + B.b == -1",
        "R <- GROUP BY a FROM B RETURN COUNT(*)",
        "R <- GROUP BY a FROM B HAVING COUNT(*) > 0 RETURN SUM(*)",
        "R1 R2 <- GROUP BY a FROM B HAVING COUNT(*) > 0 RETURN COUNT(*)",
        "SETBUFFER x",
        "LIST THINGS",
        "R <- PATH G 1 x",
        "R <- PATH G 1 2 WHERE A1(X)",
        "LOAD GRAPH G X",
        "INDEX ON a FROM B USING TRIE",
    ],
)
def test_syntax_errors(line):
    with pytest.raises(C.CommandSyntaxError):
        C.parse(line)


def test_bad_files(s, tmp_path):
    with pytest.raises(ValueError):
        s.execute("LOAD DUP")
    (tmp_path / "BAD.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        s.execute("LOAD BAD")


def large(tmp_path, name, nodes, edges):
    (tmp_path / f"{name} Nodes D.csv").write_text("NodeID,A1,A2\n" + "".join(f"{i},0,0\n" for i in range(nodes)))
    (tmp_path / f"{name} Edges D.csv").write_text("S,D,W,B1,B2\n" + "".join(f"{a},{b},{w},{k},0\n" for a, b, w, k in edges))


def test_large_graphs(s, tmp_path):
    large(tmp_path, "LINE10", 10_000, [(i, i + 1, 1, 0) for i in range(9_999)])
    large(tmp_path, "LINE20", 20_000, [(i, i + 1, 1, 0) for i in range(19_999)])
    large(tmp_path, "STAR", 10_000, [(0, i, 1, 0) for i in range(1, 10_000)])
    large(tmp_path, "GAP", 10_000, [(i, i + 1, 1, 0) for i in range(5_000)])
    rng = random.Random(42)
    few = [(rng.randint(0, 999), rng.randint(0, 999), 1, rng.randint(0, 1)) for _ in range(5_000)]
    large(tmp_path, "RANDOM", 1_000, few)
    for name in ("LINE10", "LINE20", "STAR", "GAP", "RANDOM"):
        assert s.execute(f"LOAD GRAPH {name} D").startswith("Loaded Graph.Node Count:")
    assert s.execute("P1 <- PATH LINE10 0 1 WHERE B1(E)==0") == "TRUE 1"
    assert s.execute("P2 <- PATH LINE10 0 9999 WHERE B1(E)==0") == "TRUE 9999"
    assert s.execute("P3 <- PATH LINE20 0 100 WHERE A2(N)==0") == "TRUE 100"
    assert s.execute("P4 <- PATH LINE20 0 19999 WHERE A2(N) AND ANY(E)") == "TRUE 19999"
    assert s.execute("DEGREE STAR 0") == "9999" and s.execute("DEGREE STAR 5") == "1"
    assert s.execute("P5 <- PATH GAP 0 9999 WHERE A2(N)==0") == "FALSE"
    assert s.execute("DEGREE RANDOM 0") == str(sum((a == 0) + (b == 0) for a, b, *_ in few))


def test_files_of_another_shape_are_told(s, tmp_path):
    (tmp_path / "BAD.csv").write_text("a,b\n1,x\n")
    (tmp_path / "script.ra").write_text("LOAD BAD\nLOAD DUP\nLOAD B\nPRINT B\n")
    said = s.execute("SOURCE script").split("\n")
    assert said[0].startswith("ERROR") and said[1].startswith("FORMAT ERROR") and said[-1] == "Row Count: 4"


def test_distinct_values_of_every_column(s):
    s.execute("LOAD EMPLOYEE")
    assert "Distinct Values: Ssn=8, Bdate=6, Sex=2, Salary=6, Super_ssn=4, Dno=3" in s.execute("DESCRIBE EMPLOYEE")
